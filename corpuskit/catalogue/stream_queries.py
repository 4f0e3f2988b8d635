"""Streaming queries: they read the tables as streams and return what was stored."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from corpuskit.catalogue import request_queries
from corpuskit.catalogue.listing_queries import landed_payloads
from corpuskit.catalogue.views import REQUEST_LOG, table, view, with_views
from corpuskit.session import scratch_path
from corpuskit.streaming import health
from corpuskit.streaming.dedupe import dedupe_stream as deduped
from corpuskit.streaming.ingest import ingest_stream as ingest


# The log spans the first 30 days of a month.
DAY = "extract(day from ts)"


def request_log_stream(spark, sf_dir):
    """The request log, read as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events.createOrReplaceTempView("events")
    return spark.sql(REQUEST_LOG)


def ingest_stream(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "progress")
    ingest(spark, landed_payloads(spark, sf_dir), out, checkpoint, files_per_batch=50).awaitTermination()
    return spark.read.parquet(f"{out}/run=main").select("collection", "number", F.col("year").cast("int").alias("year"))


def _deduped(spark, stream, horizon):
    out, checkpoint = scratch_path(spark, "deduped"), scratch_path(spark, "progress")
    (
        deduped(stream, ["endpoint_id", "status"], "ts", horizon).select("endpoint_id", "status", "late")
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(out)


def dedupe_stream(spark, sf_dir):
    return _deduped(spark, request_log_stream(spark, sf_dir), "60 days").select("endpoint_id", "status")


def landed_log(spark, sf_dir, parts):
    """The request log as a file stream, one file a micro-batch, in the order of the conditions ``parts``."""
    log, src = view(spark, sf_dir, "request_log"), scratch_path(spark, "log")
    for at, part in enumerate(parts):
        # Files are taken in the order of their modification times, whose grain may be a second.
        log.where(part).coalesce(1).write.mode("append").parquet(src)
        if at < len(parts) - 1:
            time.sleep(1.1)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)


def dedupe_late_stream(spark, sf_dir):
    """The newest third of the log arrives first, so later micro-batches bring first sightings that are late."""
    return _deduped(spark, landed_log(spark, sf_dir, [f"{DAY} > 20", f"{DAY} between 11 and 20", f"{DAY} <= 10"]), "12 days")


def health_stream(spark, sf_dir):
    state, checkpoint = scratch_path(spark, "health"), scratch_path(spark, "progress")
    log = request_log_stream(spark, sf_dir)
    query, run = health.health_stream(log, "endpoint_id", request_queries.ORDER, state, checkpoint)
    query.awaitTermination()
    return health.read_health(log, "endpoint_id", state, run)


QUERIES = {f.__name__: f for f in [ingest_stream, dedupe_stream, dedupe_late_stream, health_stream]}

ORACLE = {
    "ingest_stream": with_views("""select collection, number, year from ruling_keys
        where number is not null and year is not null""", "ruling_keys"),
    "dedupe_stream": with_views("select distinct endpoint_id, status from request_log", "request_log"),
    "dedupe_late_stream": with_views(f"""select * from (
        with arrived as (select *, case when {DAY} > 20 then 1 when {DAY} > 10 then 2 else 3 end as batch from request_log),
        marks as (select b.range as batch, (select max(ts) from arrived a where a.batch < b.range) - interval 12 day as mark from range(1, 4) b),
        firsts as (select *, min(batch) over (partition by endpoint_id, status) as first_batch from arrived)
        select endpoint_id, status, coalesce(min(ts) < min(mark), false) as late
        from firsts join marks using (batch) where batch = first_batch group by endpoint_id, status)""", "request_log"),
    "health_stream": request_queries.HEALTH,
}
