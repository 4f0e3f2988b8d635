"""Landed listing pages to the documents still to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.rulings import doc_path, doc_url
from corpuskit.operators.ordered import assign_batches
from corpuskit.operators.rulings import pending_documents, with_doc_key
from corpuskit.session import materialise
from corpuskit.sources.payloads import explode_items, read_search_payloads


def run_backlog(
    spark: SparkSession,
    payloads: str,
    manifest: DataFrame,
    collection: Column,
    base_url: str,
    batch_size: int = 20,
) -> DataFrame:
    """Pending documents with their address and place, in fixed-size work batches per collection."""
    items = with_doc_key(explode_items(read_search_payloads(spark, payloads)))
    candidates = items.select("file", "idx", F.upper(collection).alias("collection"), "year", "number")
    # Numbered from a copy, because numbering looks at its input more than once.
    pending = materialise(pending_documents(candidates, manifest, ["file", "idx"]), "pending")
    order = [F.col("file").asc(), F.col("idx").asc(), F.col("number").asc(), F.col("year").asc()]
    key = [F.col("collection"), F.col("year"), F.col("number")]
    return assign_batches(pending, ["collection"], order, batch_size).withColumns(
        {"url": doc_url(base_url, *key), "path": doc_path(*key)})
