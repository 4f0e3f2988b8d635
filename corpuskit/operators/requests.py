"""Request outcomes: totals, throttling streaks and endpoint health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.requests import classify_status, is_throttled
from corpuskit.operators.ordered import running_totals


def outcome_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests in total and per outcome class; ``other`` joins failures and errors."""
    outcome = classify_status(F.col("status"))
    return log.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(outcome == "ok").alias("ok"),
        F.count_if(outcome == "blocked").alias("blocked"),
        F.count_if(outcome == "server_err").alias("server_err"),
        F.count_if(outcome.isin("fail", "error")).alias("other"),
    )


def throttle_streaks(log: DataFrame, group: list[str], order: list[str], threshold: int = 0) -> DataFrame:
    """Runs of consecutive throttled requests and how often each trips the breaker.

    The counter restarts after a trip, so a run trips once per ``threshold`` requests;
    a threshold of 0 turns the breaker off.
    """
    throttled = is_throttled(F.col("status"))
    marked = log.select(*group, *order, throttled.alias("_bad"))
    # Requests of one run share the number of requests before it that were let through.
    runs = running_totals(marked, group, [F.col(c).asc() for c in order], {"passed_before": (~F.col("_bad")).cast("int")})
    at = F.struct(*order)
    trips = F.floor(F.col("run_length") / threshold) if threshold > 0 else F.lit(0).cast("bigint")
    return (
        runs.where("_bad").groupBy(*group, "passed_before")
        .agg(F.count(F.lit(1)).alias("run_length"), F.min(at).alias("_first"), F.max(at).alias("_last"))
        .select(
            *group, "passed_before", "run_length", trips.alias("trips"),
            *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order],
            *[F.col(f"_last.{c}").alias(f"last_{c}") for c in order],
        )
    )


def counts_as_failure(status: Column) -> Column:
    """Failures held against an endpoint: everything but success and a missing document."""
    return ~classify_status(status).isin("ok") & ~F.coalesce(status == 404, F.lit(False))


def endpoint_runs(log: DataFrame, endpoint: str, order: list[str]) -> DataFrame:
    """Failures of an endpoint between two successes: ``successes_before, failures``.

    A success opens a new run, so the run with the most successes before it is the
    current one. A missing document neither adds to a run nor ends it.
    """
    status = F.col("status")
    marked = log.select(
        endpoint, *order, (status == 200).alias("_ok"), counts_as_failure(status).alias("_failed"))
    totals = running_totals(
        marked, [endpoint], [F.col(c).asc() for c in order],
        {"successes_before": F.coalesce(F.col("_ok"), F.lit(False)).cast("int")},
    )
    return totals.groupBy(endpoint, "successes_before").agg(
        F.count_if("_failed").alias("failures"), F.count(F.lit(1)).alias("requests"))


def endpoint_health(log: DataFrame, endpoint: str, order: list[str], max_failures: int = 3) -> DataFrame:
    """State of each endpoint after its last request, and how often it was disabled on the way."""
    limit = max(1, max_failures)
    return (
        endpoint_runs(log, endpoint, order)
        .groupBy(endpoint).agg(
            F.sum("requests").alias("requests"),
            F.sum("failures").alias("failures"),
            F.max("failures").alias("longest_run"),
            F.count_if(F.col("failures") >= limit).alias("times_disabled"),
            F.max_by("failures", "successes_before").alias("current_run"),
        )
        .withColumn("disabled", F.col("current_run") >= limit)
    )
