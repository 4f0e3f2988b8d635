"""Measures of use, training material and erasure."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalogue.views import table, view, with_views
from corpuskit.operators import dialogue, engagement, erasure
from corpuskit.session import scratch_path

RATINGS = "select doc_id, cast(doc_id % 12 as int) as month, 1 + 4 * quality as rating from labels"
MESSAGES = """select conv_id, turn, role, case when (conv_id + turn) % 7 = 0 then '...' when (conv_id + turn) % 11 = 0 then null
    else text end as text from conversations"""
REQUESTS = """select c_custkey as user_id, date '2024-02-01' + cast(c_custkey % 9 as int) as asked_on from customer where c_custkey % 5 = 0
    union all select c_custkey, date '2024-01-20' + cast(c_custkey % 9 as int) from customer where c_custkey % 15 = 0"""


def _given(spark, sf_dir, base, sql):
    table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(sql)


def session_engagement(spark, sf_dir):
    return engagement.session_engagement(table(spark, sf_dir, "events"))


def weekly_retention(spark, sf_dir):
    """By week, for the events span one month."""
    return engagement.retention(table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')"), period="week")


def conversion(spark, sf_dir):
    return engagement.conversion(table(spark, sf_dir, "events"))


def response_and_uptime(spark, sf_dir):
    return engagement.response_and_uptime(view(spark, sf_dir, "request_log"), most_ms=50.0)


def period_over_period(spark, sf_dir):
    return engagement.period_over_period(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


def day_schedule(spark, sf_dir):
    return engagement.day_schedule(table(spark, sf_dir, "events"), "ts", "2024-01-15", "event_id")


def compare_arms(spark, sf_dir):
    return engagement.compare_arms(table(spark, sf_dir, "events"))


def satisfaction(spark, sf_dir):
    return engagement.satisfaction(_given(spark, sf_dir, "labels", RATINGS), "month", "rating")


def dialogue_samples(spark, sf_dir):
    return dialogue.dialogue_samples(_given(spark, sf_dir, "conversations", MESSAGES))


def select_clips(spark, sf_dir):
    return dialogue.select_clips(view(spark, sf_dir, "cues"), fewest=2, most=3)


def train_validation_split(spark, sf_dir):
    return dialogue.train_validation_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


def route_by_language(spark, sf_dir):
    path = scratch_path(spark, "languages")
    dialogue.route_by_language(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return spark.read.parquet(path)


def erase_subjects(spark, sf_dir):
    kept, _ = erasure.erase_subjects(table(spark, sf_dir, "events"), _given(spark, sf_dir, "customer", REQUESTS), "user_id")
    return kept


def erasure_receipts(spark, sf_dir):
    _, receipts = erasure.erase_subjects(table(spark, sf_dir, "events"), _given(spark, sf_dir, "customer", REQUESTS), "user_id")
    return receipts


QUERIES = {f.__name__: f for f in [
    session_engagement, weekly_retention, conversion, response_and_uptime, period_over_period, day_schedule, compare_arms,
    satisfaction, dialogue_samples, select_clips, train_validation_split, route_by_language, erase_subjects, erasure_receipts,
]}

_HASH = "cast(concat('0x', substring(md5(concat('42:', coalesce(cast({} as varchar), ''))), 1, 8)) as bigint)"

ORACLE = {
    "session_engagement": """
        with marked as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute
                          then 0 else 1 end as begins from events),
        numbered as (select user_id, ts, sum(begins) over (partition by user_id order by ts rows unbounded preceding) as no from marked),
        sessions as (select date_diff('microsecond', min(ts), max(ts)) as micros from numbered group by user_id, no)
        select count(*) as sessions, cast(sum(micros) as bigint) as total_micros, sum(micros) / count(*) / 1e6 as mean_seconds,
          count(*) filter (where micros >= 1200000000) as target_sessions from sessions""",
    "weekly_retention": """
        with active as (select distinct user_id, cast(date_trunc('week', ts) as date) as period from events
                        where event_type in ('signup', 'purchase'))
        select a.period, count(*) as active, count(b.user_id) as retained, count(b.user_id) / count(*) as retention,
          count(b.user_id) / count(*) >= 0.6 as met
        from active a left join active b on a.user_id = b.user_id and b.period = a.period + 7
        where a.period < (select max(period) from active) group by a.period""",
    "conversion": """
        with users as (select user_id, min(ts) filter (where event_type = 'signup') as began,
                         max(ts) filter (where event_type = 'purchase') as reached from events group by user_id)
        select count(began) as started, count(*) filter (where reached >= began) as converted,
          count(*) filter (where reached >= began) / count(began) as share,
          count(*) filter (where reached >= began) / count(began) >= 0.05 as met from users""",
    "response_and_uptime": with_views("""
        select count(*) as requests, quantile_cont(latency_ms, 0.5) as p50_ms, quantile_cont(latency_ms, 0.95) as p95_ms,
          count(*) filter (where latency_ms <= 50) as fast, count(*) filter (where status < 500) / count(*) as availability,
          count(*) filter (where status < 500) / count(*) >= 0.995 as met from request_log""", "request_log"),
    "period_over_period": """
        with months as (select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as rows,
                          cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders group by 1)
        select month, rows, amount, 100.0::double * (rows::double - b.rows0) / b.rows0 as rows_change,
          100.0::double * (amount - b.amount0) / b.amount0 as amount_change
        from months left join (select month + interval 1 month as month0, rows as rows0, amount as amount0 from months) b
          on months.month = b.month0""",
    "day_schedule": "select * from events where ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-16'",
    "compare_arms": f"""
        with users as (select user_id, count(*) as n, max(case when event_type = 'purchase' then 1 else 0 end) as reached
                       from events group by user_id)
        select cast({_HASH.format('user_id')} % 2 as int) as arm, count(*) as users, cast(sum(n) as bigint) as events,
          cast(sum(reached) as bigint) as reached, sum(reached) / count(*) as share from users group by 1""",
    "satisfaction": f"""select month, count(rating) as ratings, sum(rating) / count(rating) as mean,
          sum(rating) / count(rating) >= 4.5 as met from ({RATINGS}) where rating is not null group by month""",
    "dialogue_samples": f"""select conv_id, count(*) as messages, string_agg(concat(role, ': ', text), chr(10) order by turn) as sample
        from ({MESSAGES}) where text is not null and lower(trim(text)) not in ('', '...', '…', 'typing...', 'typing…') group by conv_id""",
    "select_clips": with_views("""
        select file_id, count(*) as clips, cast(sum(end_ms - start_ms) as bigint) as millis, count(*) between 2 and 3 as enough
        from cues where end_ms - start_ms between 3000 and 10000 group by file_id""", "cues"),
    "train_validation_split": f"""select doc_id, lang, case when {_HASH.format('doc_id')} < 429496730 then 'validation' else 'train' end as split
        from documents""",
    "route_by_language": "select doc_id, lang, n_chars from documents",
    "erase_subjects": f"select * from events where user_id not in (select user_id from ({REQUESTS}) where user_id is not null)",
    "erasure_receipts": f"""
        with asked as (select user_id, min(asked_on) as asked_on from ({REQUESTS}) group by user_id)
        select a.user_id, a.asked_on,
          list_filter(list_transform(range(1, 30), lambda i: a.asked_on + cast(i as int)), lambda d: dayofweek(d) not in (0, 6))[14] as due_on,
          (select count(*) from events e where e.user_id = a.user_id) as rows_erased
        from asked a""",
}
