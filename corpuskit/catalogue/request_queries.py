"""Request outcomes, endpoints, work batches and sign-up addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalogue.views import table, view, with_views
from corpuskit.functions.requests import classify_status, is_final
from corpuskit.functions.requests import mask_credentials as masked
from corpuskit.functions.text import is_valid_email
from corpuskit.operators import requests
from corpuskit.operators.ordered import assign_batches
from corpuskit.sources import endpoints

ORDER = ["ts", "req_id"]
ODD_ENDPOINTS = """select c_custkey as line_no,
    case c_custkey % 4 when 0 then 'http://u:' when 1 then 'socks5://:' when 2 then 'u@mail.example:' else 'https://u:' end as front,
    concat('s3', c_custkey, case c_custkey % 3 when 0 then '@x' when 1 then ':y' else '@z:@' end) as secret,
    concat('@h', c_custkey, ':80/p@q:r') as rear from customer"""


def request_classes(spark, sf_dir):
    return view(spark, sf_dir, "request_log").select(
        "req_id", classify_status(F.col("status")).alias("outcome"), is_final(F.col("status")).alias("final"))


def outcome_summary(spark, sf_dir):
    return requests.outcome_summary(view(spark, sf_dir, "request_log"))


def outcome_by_endpoint(spark, sf_dir):
    return requests.outcome_summary(view(spark, sf_dir, "request_log"), ["endpoint_id"])


def throttle_streaks(spark, sf_dir):
    return requests.throttle_streaks(view(spark, sf_dir, "request_log"), ["endpoint_id"], ORDER, threshold=2)


def endpoint_health(spark, sf_dir):
    return requests.endpoint_health(view(spark, sf_dir, "request_log"), "endpoint_id", ORDER)


def work_batches(spark, sf_dir):
    keys = view(spark, sf_dir, "ruling_keys").select("collection", "item_id")
    return assign_batches(keys, ["collection"], [F.asc("item_id")], 20)


def normalise_endpoints(spark, sf_dir):
    return endpoints.normalise_endpoints(view(spark, sf_dir, "endpoints"))


def mask_credentials(spark, sf_dir):
    lines = endpoints.normalise_endpoints(view(spark, sf_dir, "endpoints")).where("valid")
    return lines.select("line_no", masked(F.col("endpoint")).alias("shown"))


def mask_credentials_http(spark, sf_dir):
    lines = endpoints.normalise_endpoints(view(spark, sf_dir, "endpoints")).where("valid and endpoint rlike '^https?://'")
    return lines.select("line_no", masked(F.col("endpoint")).alias("shown"))


def mask_odd_credentials(spark, sf_dir):
    """Passwords with ``@`` and ``:`` in them, users without a name or with ``@``, and any scheme."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    shown = masked(F.concat("front", "secret", "rear"))
    return spark.sql(ODD_ENDPOINTS).select("line_no", shown.alias("shown"), F.contains(shown, F.col("secret")).alias("leaks"))


def valid_emails(spark, sf_dir):
    return view(spark, sf_dir, "waitlist").select("signup_id", is_valid_email(F.col("email")).alias("valid"))


QUERIES = {f.__name__: f for f in [
    request_classes, outcome_summary, outcome_by_endpoint, throttle_streaks, endpoint_health, work_batches,
    normalise_endpoints, mask_credentials, mask_credentials_http, mask_odd_credentials, valid_emails,
]}

_OUTCOMES = """count(*) as total, count(*) filter (where status = 200) as ok,
    count(*) filter (where status in (403, 429)) as blocked,
    count(*) filter (where status between 500 and 599) as server_err,
    count(*) filter (where status is null or not (status in (200, 403, 429) or status between 500 and 599)) as other"""
HEALTH = with_views("""
    select endpoint_id, cast(sum(requests) as bigint) as requests, cast(sum(fails) as bigint) as failures,
      max(fails) as longest_run, count(*) filter (where fails >= 3) as times_disabled,
      arg_max(fails, passed) as current_run, arg_max(fails, passed) >= 3 as disabled
    from (select endpoint_id, passed, count(*) as requests,
            count(*) filter (where status is null or status not in (200, 404)) as fails
          from (select *, sum(case when status = 200 then 1 else 0 end) over (
                  partition by endpoint_id order by ts, req_id rows unbounded preceding) as passed from request_log)
          group by endpoint_id, passed)
    group by endpoint_id""", "request_log")
_LINES = """select line_no, line, case line_no % 7
      when 0 then concat('http://h', line_no, ':8080') when 1 then concat('http://u', line_no, ':s3cret@h', line_no, ':8080')
      when 2 then concat('http://u', line_no, ':s3cret@h', line_no, ':80') when 3 then line end as endpoint
    from endpoints where trim(line) <> '' and trim(line) not like '#%'"""

ORACLE = {
    "request_classes": with_views("""
        select req_id, case when status is null then 'error' when status = 200 then 'ok'
            when status in (403, 429) then 'blocked' when status between 500 and 599 then 'server_err'
            else 'fail' end as outcome, coalesce(status in (200, 404), false) as final
        from request_log""", "request_log"),
    "outcome_summary": with_views(f"select {_OUTCOMES} from request_log", "request_log"),
    "outcome_by_endpoint": with_views(
        f"select endpoint_id, {_OUTCOMES} from request_log group by endpoint_id", "request_log"),
    "throttle_streaks": with_views("""
        select endpoint_id, cast(passed as bigint) as passed_before, count(*) as run_length, count(*) // 2 as trips,
          min(ts) as first_ts, max(ts) as last_ts,
          arg_min(req_id, (ts, req_id)) as first_req_id, arg_max(req_id, (ts, req_id)) as last_req_id
        from (select *, sum(case when coalesce(status in (403, 429), false) then 0 else 1 end) over (
                partition by endpoint_id order by ts, req_id rows unbounded preceding) as passed from request_log)
        where status in (403, 429) group by endpoint_id, passed""", "request_log"),
    "endpoint_health": HEALTH,
    "work_batches": with_views("""
        select collection, item_id, cast(floor((rn - 1) / 20) as bigint) as batch, (rn - 1) % 20 as position
        from (select collection, item_id, row_number() over (partition by collection order by item_id) as rn
              from ruling_keys)""", "ruling_keys"),
    "normalise_endpoints": with_views(
        f"select line_no, line, endpoint, endpoint is not null as valid from ({_LINES})", "endpoints"),
    "mask_credentials": with_views(rf"""
        select line_no, replace(endpoint, 's3cret', '****') as shown from ({_LINES}) where endpoint is not null""", "endpoints"),
    "mask_credentials_http": with_views(rf"""
        select line_no, replace(endpoint, 's3cret', '****') as shown
        from ({_LINES}) where starts_with(endpoint, 'http')""", "endpoints"),
    "mask_odd_credentials": f"select line_no, concat(front, '****', rear) as shown, false as leaks from ({ODD_ENDPOINTS})",
    "valid_emails": with_views(
        r"select signup_id, regexp_matches(email, '^[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,4}\z') as valid from waitlist",
        "waitlist"),
}
