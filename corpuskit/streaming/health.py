"""Endpoint health kept up to date micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from corpuskit.operators.requests import endpoint_runs
from corpuskit.streaming.state import batch_path, open_store, read_latest, run_name, write_batch

COUNTERS = ["requests", "failures", "longest_run", "times_disabled", "current_run"]


def health_schema(log: DataFrame, endpoint: str) -> StructType:
    return StructType([
        log.schema[endpoint], *[StructField(c, LongType()) for c in COUNTERS], StructField("disabled", BooleanType())])


def batch_digest(log: DataFrame, endpoint: str, order: list[str], limit: int) -> DataFrame:
    """All that a batch says about an endpoint: its runs, the first of which may go on
    from the batch before and the last of which may go on in the next."""
    later = F.col("successes_before") > 0
    return endpoint_runs(log, endpoint, order).groupBy(endpoint).agg(
        F.sum("requests").alias("b_requests"),
        F.sum("failures").alias("b_failures"),
        F.coalesce(F.max(F.when(~later, F.col("failures"))), F.lit(0)).alias("b_first_run"),
        F.coalesce(F.max(F.when(later, F.col("failures"))), F.lit(0)).alias("b_longest_later"),
        F.count_if(later & (F.col("failures") >= limit)).alias("b_disabled_later"),
        F.max_by("failures", "successes_before").alias("b_last_run"),
        F.max("successes_before").alias("b_successes"),
    )


def merge_health(state: DataFrame, digest: DataFrame, endpoint: str, limit: int) -> DataFrame:
    """State after a batch; both sides have one row per endpoint."""
    def had(name: str):
        return F.coalesce(F.col(name), F.lit(0))

    resumed = had("current_run") + had("b_first_run")
    newly_disabled = ((resumed >= limit) & (had("current_run") < limit)).cast("bigint")
    current = F.when(had("b_successes") > 0, F.col("b_last_run")).otherwise(resumed)
    return (
        state.join(digest, endpoint, "full_outer")
        .select(
            endpoint,
            (had("requests") + had("b_requests")).alias("requests"),
            (had("failures") + had("b_failures")).alias("failures"),
            F.greatest(had("longest_run"), resumed, had("b_longest_later")).alias("longest_run"),
            (had("times_disabled") + newly_disabled + had("b_disabled_later")).alias("times_disabled"),
            current.alias("current_run"),
        )
        .withColumn("disabled", F.col("current_run") >= limit)
    )


def health_stream(
    log: DataFrame,
    endpoint: str,
    order: list[str],
    state: str,
    checkpoint: str,
    max_failures: int = 3,
    restart: bool = False,
) -> tuple[StreamingQuery, str]:
    """Starts the query; returns it and the name of its run, for `read_health`.

    Batches are taken in arrival order and ordered within themselves. Each is reduced to
    one row per endpoint by the same skew-proof totals as the batch operator before it
    meets the state, so a busy endpoint is never handled by one task.
    """
    limit, run, schema = max(1, max_failures), run_name(restart), health_schema(log, endpoint)
    open_store(log.sparkSession, state, run, schema)

    def update(batch: DataFrame, batch_id: int) -> None:
        before = batch.sparkSession.read.schema(schema).parquet(batch_path(state, run, batch_id - 1))
        digest = batch_digest(batch, endpoint, order, limit)
        write_batch(merge_health(before, digest, endpoint, limit), state, run, batch_id)

    query = (
        log.writeStream.foreachBatch(update)
        .option("checkpointLocation", f"{checkpoint}/{run}").trigger(availableNow=True).start()
    )
    return query, run


def read_health(log: DataFrame, endpoint: str, state: str, run: str) -> DataFrame:
    return read_latest(log.sparkSession, state, run, health_schema(log, endpoint))
