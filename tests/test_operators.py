"""Operators against brute force and invariants."""

import itertools
import os
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.functions.requests import classify_status
from corpuskit.operators import audit, cues, profile, requests, rulings, sample
from corpuskit.operators.inference import glossary_model, map_text_batches
from corpuskit.plans.audit import run_audit
from corpuskit.plans.backlog import run_backlog
from corpuskit.plans.etl import EtlOptions, run_etl
from corpuskit.plans.profile import run_profile
from corpuskit.plans.translate import run_translation, translate_cues
from corpuskit.session import shared_root
from corpuskit.sinks.tables import write_csv
from corpuskit.sources.bulk_csv import read_bulk_csv
from corpuskit.sources.subtitles import read_subtitles


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    statuses = [200, 200, 403, 429, 500, 404, None]
    rows = [(i, 0 if rng.random() < 0.5 else rng.randrange(6), rng.choice(statuses)) for i in range(2_000)]
    return spark.createDataFrame(rows, "req_id long, endpoint_id long, status int").repartition(5)


def by_endpoint(log):
    rows = sorted(log.collect(), key=lambda r: (r.endpoint_id, r.req_id))
    return {k: list(g) for k, g in itertools.groupby(rows, key=lambda r: r.endpoint_id)}


def test_throttle_streaks(spark, log):
    expected = []
    for endpoint, rows in by_endpoint(log).items():
        for bad, run in itertools.groupby(rows, key=lambda r: r.status in (403, 429)):
            run = list(run)
            if bad:
                expected.append((endpoint, len(run), len(run) // 2, run[0].req_id, run[-1].req_id))
    got = requests.throttle_streaks(log, ["endpoint_id"], ["req_id"], 2).select(
        "endpoint_id", "run_length", "trips", "first_req_id", "last_req_id")
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert requests.throttle_streaks(log, ["endpoint_id"], ["req_id"], 0).agg(F.max("trips")).first()[0] == 0


def test_endpoint_health_equals_a_live_counter(spark, log):
    expected = {}
    for endpoint, rows in by_endpoint(log).items():
        count = disabled = times = longest = 0
        for r in rows:
            if r.status == 200:
                count, disabled = 0, False
            elif r.status != 404:
                count += 1
                longest = max(longest, count)
                if count >= 3 and not disabled:
                    disabled, times = True, times + 1
        expected[endpoint] = (len(rows), longest, times, count, bool(disabled))
    got = requests.endpoint_health(log, "endpoint_id", ["req_id"])
    assert {r.endpoint_id: (r.requests, r.longest_run, r.times_disabled, r.current_run, r.disabled)
            for r in got.collect()} == expected


def test_outcomes_add_up(log):
    row = requests.outcome_summary(log).first()
    assert row.total == row.ok + row.blocked + row.server_err + row.other == 2_000
    assert {r[0] for r in log.select(classify_status(F.col("status"))).distinct().collect()} == {
        "ok", "blocked", "server_err", "fail", "error"}


def test_exact_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "x" * rng.randrange(300) for _ in range(1_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lengths = np.array([len(t or "") for t in texts])
    expected = tuple(int(np.quantile(lengths, q)) for q in (0.5, 0.9, 0.99))
    assert tuple(profile.exact_quantiles(df, "t").first()) == expected
    close = audit.approx_quantiles(df, F.coalesce(F.length("t"), F.lit(0)), [0.5, 0.99]).first()[0]
    assert abs(close[0] - expected[0]) <= 1


def test_approx_quantiles_keep_their_rank_error(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.length("text").alias("n"))
    lengths = np.sort([r.n for r in docs.collect()])
    for accuracy in (100, 10_000):
        got = audit.approx_quantiles(docs, F.col("n"), audit.AUDIT_QUANTILES, accuracy).first()[0]
        for q, value in zip(audit.AUDIT_QUANTILES, got):
            low, high = np.searchsorted(lengths, value, "left"), np.searchsorted(lengths, value, "right")
            slack = len(lengths) / accuracy + 1
            assert low - slack <= q * len(lengths) <= high + slack


def test_discrete_quantiles_equal_quantile_disc(spark):
    """F1-F3: the report's quantiles are values of the column at their exact ranks, as DuckDB's quantile_disc."""
    import duckdb

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    expected = list(duckdb.sql(f"""select {", ".join(f"quantile_disc(length(text), {q})" for q in audit.AUDIT_QUANTILES)}
        from '/root/testdata/sf0.1/documents.parquet'""").fetchall()[0])
    assert audit.discrete_quantiles(docs, F.length("text"), audit.AUDIT_QUANTILES).first()[0] == expected
    report = audit.audit_summary(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("plain_text"))).first()
    lengths = report["lengths"]["plain_text"]
    assert [lengths[q] for q in ("p50", "p90", "p99", "p99_9")] == expected
    small = spark.createDataFrame([(3,), (1,), (None,), (2,), (2,)], "n int")
    assert audit.discrete_quantiles(small, F.col("n"), [0.0, 0.25, 0.5, 0.75, 0.999]).first()[0] == [1, 1, 2, 2, 3]
    assert audit.discrete_quantiles(small.where("n is null"), F.col("n"), [0.5]).first()[0] is None


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert audit.approx_quantiles(df, F.length("t"), [0.5]).first()[0] is None
    assert audit.approx_quantiles_coarse(df, "t", [0.5]) is None


def test_audit_summary_of_a_bare_table(spark):
    report = audit.audit_summary(spark.createDataFrame([(1,), (2,)], "id long"), expected=["id", "html"], source="x.csv").first()
    assert report.csv_path == "x.csv" and report.total_rows == 2 and report.missing_expected_columns == ["html"] and report.lengths is None


def test_audit_summary_orders_its_lists(spark):
    rows = [(i, None if i == 3 else "x" * (i % 4) + ("\x07" if i > 6 else ""), "ab"[i % 2]) for i in range(10)]
    report = audit.audit_summary(spark.createDataFrame(rows, "id long, plain_text string, type string")).first()
    lengths = report.lengths.plain_text
    assert [(r.id, r.length) for r in lengths.longest] == [(7, 4), (9, 2), (2, 2), (6, 2), (8, 1)] or sorted(
        lengths.longest, key=lambda r: (-r.length, r.id)) == lengths.longest
    assert lengths.buckets == {"<=1k": 9, "null": 1}
    assert [e.id for e in report.control_chars.plain_text.examples] == [7, 8, 9]
    assert [(t.value, t.row_count) for t in report.top_values.type] == [("a", 5), ("b", 5)]


def test_null_rates_ignore_empty_text(spark):
    df = spark.createDataFrame([("", None), ("x", "y"), (None, "z")], "a string, b string")
    assert [tuple(r) for r in profile.null_rates(df).collect()] == [("a", 33.33), ("b", 33.33)]


@pytest.mark.parametrize("cap", [None, 150, 1])
def test_sample_does_not_depend_on_partitions(spark, cap):
    picks = []
    for parts in (1, 3, 8):
        df = spark.range(4_000).repartition(parts)
        picks.append(sorted(r.id for r in sample.bernoulli_sample(df, "id", 10.0, cap).collect()))
    assert picks[0] == picks[1] == picks[2]
    assert len(picks[0]) == (cap or len(picks[0])) and 300 < len(sample_all(spark)) < 500


def sample_all(spark):
    return sample.bernoulli_sample(spark.range(4_000), "id", 10.0, None).collect()


def test_sample_edges(spark):
    nulls = spark.createDataFrame([(None, i) for i in range(20)], "id long, i long")
    assert sample.bernoulli_sample(nulls, "id", 100.0).count() == 20
    df = spark.range(50)
    assert sample.bernoulli_sample(df, "id", 250.0).count() == 50
    assert sample.bernoulli_sample(df, "id", -1.0).count() == 0
    assert [r.id for r in sample.bernoulli_sample(df, "id", -1.0, fallback=10).orderBy("id").collect()] == list(range(10))
    assert sample.bernoulli_sample(df, "id", 100.0, fallback=10).count() == 50
    assert sample.random_rows(spark.range(3), "id").count() == 3
    assert sample.random_rows(spark.range(11), "id").count() == 5


def test_pending_and_stored_make_up_the_candidates(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["NY", "HQ"]), 2001, None if rng.random() < 0.1 else f"N{rng.randrange(40)}", i) for i in range(300)]
    rows += [("NY", 2001, "N1", 1_000 + i) for i in range(300)]  # one document listed over and over
    items = spark.createDataFrame(rows, "collection string, year int, number string, at long")
    manifest = items.where("at % 4 = 0 and number is not null").withColumn("bytes", F.col("at") % 8)
    pending = rulings.pending_documents(items, manifest, ["at"])
    keys = {r[:3] for r in rows if r[2]}
    done = {tuple(r)[:3] for r in manifest.where("bytes > 0").collect()}
    got = [tuple(r) for r in pending.collect()]
    assert {r[:3] for r in got} == keys - done and len(got) == len(keys - done)
    first = {}
    for r in rows:
        first.setdefault(r[:3], r[3])
    assert all(first[r[:3]] == r[3] for r in got)


def test_backlog_reads_pretty_printed_pages(spark, folder):
    with open(folder + "/p.json", "w") as f:
        f.write('{\n "hits": [\n {"number": "N1",\n "date": "2001"},\n {"title": "no key"},\n {"number": "N2", "date": "2002"}\n]\n}\n')
    manifest = spark.createDataFrame([("NY", 2001, "N1", 5)], "collection string, year int, number string, bytes long")
    row = run_backlog(spark, folder, manifest, F.lit("ny"), "http://x/doc").collect()
    assert [(r.url, r.path, r.batch) for r in row] == [("http://x/doc/ny/2002/N2.pdf", "NY/2002/N2.pdf", 0)]


def test_model_is_asked_in_batches(spark):
    def factory():
        return lambda texts: [f"{len(texts)}:{t}" for t in texts]

    df = spark.createDataFrame([(i, None if i == 4 else str(i)) for i in range(70)], "i long, t string").coalesce(1)
    got = {r.i: r.translated for r in map_text_batches(df, "t", factory, batch_size=32).collect()}
    assert got[4] is None and got[0] == "32:0" and got[69] == "5:69"
    assert map_text_batches(df, "t", factory, parallelism=3).count() == 70


def test_interrupted_translation_goes_on(spark):
    df = spark.createDataFrame([(1, 1, "a\nb"), (1, 2, "the end")], "file_id long, cue_no long, text string")
    done = spark.createDataFrame([(1, 1, "X Y")], "file_id long, cue_no long, translated string")
    got = translate_cues(df, glossary_model({"the": "THE"}), done=done).orderBy("cue_no").collect()
    assert [r.text for r in got] == ["X\nY", "THE end"]
    assert cues.cue_counts(df).collect() == [(1, 2)]


def test_translation_of_files(spark, folder):
    for name, word in [("a/x.srt", "the one"), ("b/x.srt", "the two")]:
        os.makedirs(os.path.dirname(f"{folder}/in/{name}"), exist_ok=True)
        with open(f"{folder}/in/{name}", "w") as f:
            f.write(f"1\n00:00:01,000 --> 00:00:02,000\n{word}\n\n2\n00:00:03,000 --> 00:00:04,000\nend\n")
    run_translation(spark, folder + "/in", folder + "/out", glossary_model({"the": "THE"}))
    got = read_subtitles(spark, folder + "/out").orderBy("file", "cue_no").select("text").collect()
    assert [r.text for r in got] == ["THE one", "end", "THE two", "end"]


def test_audit_job_on_csv_and_on_its_stage(spark, folder):
    rows = spark.createDataFrame(
        [(str(i), "née\n" * i if i % 3 else None, "<p>" if i % 2 else "") for i in range(30)],
        "id string, plain_text string, html_with_citations string")
    write_csv(rows, folder + "/csv")
    run_etl(spark, folder + "/csv", folder + "/stage", EtlOptions(null_value="\\N"))
    by_csv = run_audit(spark, folder + "/csv", folder + "/r1").first()
    by_stage = run_audit(spark, folder + "/stage", folder + "/r2", staged=True).first()
    assert by_csv.total_rows == by_stage.total_rows == 30 and by_csv.csv_path == folder + "/csv"
    assert by_stage.missing.plain_text == 10 and by_stage.missing_all == 5
    assert by_csv.lengths.html_with_citations.p50 == by_stage.lengths.html_with_citations.p90 == 3
    assert "precedential_status" in by_csv.missing_expected_columns


def test_profile_parts(spark, folder):
    df = spark.range(100).select(
        "id", F.concat(F.lit("court"), F.col("id") % 3).alias("court_id"), F.lit("2001-02-03").alias("date_filed"),
        F.repeat(F.lit("x"), F.col("id").cast("int")).alias("plain_text"))
    parts = run_profile(df, pct=100.0, out=folder + "/sample", outfmt="csv")
    assert read_bulk_csv(spark, folder + "/sample").count() == 100
    assert set(parts) == {"sample", "head", "random", "null_rates", "lengths", "empty", "dates", "courts"}
    assert parts["sample"].count() == 100 and parts["random"].count() == 5
    assert parts["empty"].first().empty == 1
    assert set(run_profile(df.select("id"), pct=100.0)) == {"sample", "head", "random", "null_rates"}


def session_stub(master, configured=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: configured or default),
        sparkContext=SimpleNamespace(master=master, applicationId="x", getCheckpointDir=lambda: None))


def test_shared_folder(spark):
    assert shared_root(spark) == shared_root(spark)
    assert shared_root(session_stub("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared_root(session_stub("yarn"))
