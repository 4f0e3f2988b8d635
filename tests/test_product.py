"""Measures of use, training material and erasure, on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from corpuskit.operators import dialogue, engagement, erasure


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def test_sessions(spark):
    rows = [(1, at(1, 0)), (1, at(1, 0, 29)), (1, at(1, 0, 59)), (2, at(1, 5)), (2, at(1, 5)), (None, at(2, 1))]
    got = engagement.session_engagement(spark.createDataFrame(rows, "user_id int, ts timestamp")).first()
    # A gap of exactly half an hour does not end a session.
    assert (got.sessions, got.total_micros, got.target_sessions) == (3, 59 * 60 * 10**6, 1)


def test_retention_without_next_period(spark):
    rows = [(1, at(1)), (1, at(9)), (2, at(2)), (None, at(1)), (3, at(10))]
    got = engagement.retention(spark.createDataFrame(rows, "user_id int, ts timestamp"), period="week").collect()
    assert [tuple(r)[1:] for r in got] == [(2, 1, 0.5, False)]


def test_conversion_needs_the_goal_after_the_start(spark):
    rows = [(1, at(2), "signup"), (1, at(1), "purchase"), (2, at(1), "signup"), (2, at(3), "purchase"), (3, at(1), "purchase")]
    got = engagement.conversion(spark.createDataFrame(rows, "user_id int, ts timestamp, event_type string")).first()
    assert tuple(got) == (2, 1, 0.5, True)


def test_empty_tables(spark):
    events = spark.createDataFrame([], "user_id int, ts timestamp, event_type string")
    assert engagement.session_engagement(events).first().sessions == 0
    assert engagement.conversion(events).first().share is None
    assert engagement.retention(events).count() == engagement.compare_arms(events).count() == 0


def test_changes_need_the_month_before(spark):
    rows = [(dt.datetime(2024, 1, 3), 10.0), (dt.datetime(2024, 2, 3), 15.0), (dt.datetime(2024, 2, 4), 0.0), (dt.datetime(2024, 4, 1), 1.0)]
    got = engagement.period_over_period(spark.createDataFrame(rows, "at timestamp, v double"), "at", "v").orderBy("month").collect()
    assert [(r.month.month, r.rows_change, r.amount_change) for r in got] == [(1, None, None), (2, 100.0, 50.0), (4, None, None)]


def test_day_is_read_as_a_range(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = engagement.day_schedule(events, "ts", "2024-01-15", "event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_dialogues(spark):
    rows = [(1, 2, "bot", "b"), (1, 1, "user", "a"), (1, 3, "bot", " Typing... "), (2, 1, "user", None), (3, 1, None, "x")]
    got = dialogue.dialogue_samples(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, "user: a\nbot: b"), (3, 1, ": x")]


def test_split_keeps_keys_together(spark):
    rows = spark.range(5000).select((F.col("id") % 1000).alias("k"))
    got = dialogue.train_validation_split(rows, "k")
    assert got.distinct().count() == 1000
    assert 60 < got.where("split = 'validation'").distinct().count() < 140


def test_due_days(spark):
    day = lambda d: spark.range(1).select(erasure.business_days_after(F.lit(d).cast("date"), 14)).first()[0]
    assert day("2024-01-01") == dt.date(2024, 1, 19) and day("2024-01-06") == dt.date(2024, 1, 25)


def test_erasure(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "u int, v string")
    requests = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (1, dt.date(2024, 1, 2)), (9, dt.date(2024, 1, 2)), (None, None)], "u int, asked_on date")
    kept, receipts = erasure.erase_subjects(df, requests, "u")
    assert sorted(r.v for r in kept.collect()) == ["c", "d"]
    assert sorted((r.u, r.asked_on.day, r.rows_erased) for r in receipts.collect()) == [(1, 2, 2), (9, 2, 0)]
