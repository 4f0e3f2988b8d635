"""Landed JSON listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.rulings import parse_item, parse_payload, raw_items


def read_search_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per payload file: its path and its text."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
    )


def explode_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per listing item: its 0-based ``idx`` and ``item`` as a map. See `bad_items` for the rest."""
    return _raw_items(payloads, payload).withColumn("item", parse_item(F.col("raw"))).where("item is not null").drop("raw")


def bad_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """What `explode_items` passes over: items that are no objects (``idx``, ``raw``), and pages that can't be read or have
    no list of items (``idx`` null, ``raw`` the page)."""
    kept = [c for c in payloads.columns if c != payload]
    items = _raw_items(payloads, payload).where(parse_item(F.col("raw")).isNull())
    pages = payloads.where(raw_items(parse_payload(F.col(payload))).isNull()).select(
        *kept, F.lit(None).cast("int").alias("idx"), F.col(payload).alias("raw"))
    return items.unionByName(pages)


def _raw_items(payloads: DataFrame, payload: str) -> DataFrame:
    kept = [c for c in payloads.columns if c != payload]
    # Parsed in a step of its own, since the items expression looks at the payload many times.
    parsed = payloads.select(*kept, parse_payload(F.col(payload)).alias("_parsed"))
    return parsed.select(*kept, F.posexplode(raw_items(F.col("_parsed"))).alias("idx", "raw"))
