"""From listing items to the backlog of documents still to be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.requests import classify_status
from corpuskit.functions.rulings import doc_key

KEY = ["collection", "year", "number"]


def with_doc_key(items: DataFrame, item: str = "item") -> DataFrame:
    """Adds ``number`` and ``year``; either is null where the item does not tell."""
    return items.withColumn("_key", doc_key(F.col(item))).select(*items.columns, "_key.number", "_key.year")


def usable(items: DataFrame) -> DataFrame:
    """Items with a whole key; the others cannot be located."""
    return items.dropna(subset=KEY)


def first_per_key(items: DataFrame, order: list[str], key: list[str] = KEY) -> DataFrame:
    """One row per document, the first in ``order``.

    A minimum rather than a window: repeats are folded before the shuffle, so a
    document listed over and over does not gather in one task.
    """
    rest = [c for c in items.columns if c not in key]
    first = items.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*key, "_row.*").select(*items.columns)


def pending_documents(candidates: DataFrame, manifest: DataFrame, order: list[str]) -> DataFrame:
    """Documents not stored yet; an empty file does not count as stored.

    Both sides have one row per document, so no key is hot.
    """
    stored = manifest.where(F.col("bytes") > 0).select(*KEY).distinct()
    return first_per_key(usable(candidates), order).join(stored, KEY, "left_anti")


def metadata_coverage(meta: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents with metadata, with a stored file, with both, per collection.

    Presence is the same as a full outer join on the key, folded before the shuffle.
    """
    sides = usable(meta).select(*KEY, F.lit(True).alias("meta"), F.lit(False).alias("doc")).unionByName(
        usable(docs).select(*KEY, F.lit(False).alias("meta"), F.lit(True).alias("doc")))
    state = (
        F.when(F.col("meta") & F.col("doc"), "both").when(F.col("meta"), "meta_only").otherwise("doc_only")
    )
    return (
        sides.groupBy(*KEY).agg(F.max("meta").alias("meta"), F.max("doc").alias("doc"))
        .groupBy("collection", state.alias("state")).agg(F.count(F.lit(1)).alias("documents"))
    )


def harvest_progress(attempts: DataFrame, status: Column | None = None) -> DataFrame:
    """Attempts (retries included), saved and failed ones, and distinct documents, per collection."""
    outcome = classify_status(F.col("status") if status is None else status)
    per_document = attempts.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(outcome == "ok").alias("saved"))
    return per_document.groupBy("collection").agg(
        F.sum("attempts").alias("attempts"),
        F.sum("saved").alias("saved"),
        F.sum(F.col("attempts") - F.col("saved")).alias("failed"),
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("saved") > 0).alias("documents_saved"),
    )
