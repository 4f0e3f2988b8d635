"""Landed listing pages to stored documents, resuming where the last run stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskit.operators.rulings import KEY, usable, with_doc_key
from corpuskit.session import materialise
from corpuskit.sources.payloads import explode_items
from corpuskit.streaming.state import (
    REBALANCED, open_store, read_store, run_name, settings, state_parts, state_settings, write_batch,
)

LAYOUT = ["collection", "year"]


def payload_stream(spark: SparkSession, src: str, files_per_batch: int | None = None) -> DataFrame:
    """Payload files as they land: path and text."""
    reader = spark.readStream.schema("value string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(src, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))


def firsts(batches, key: list[str], order: list[str]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a key in a batch the first in ``order``; so a key listed over and over reaches its task as a few rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        at = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
        names = [f"k{i}" for i in range(len(key))]
        keys = pa.table([table.column(k).take(at) for k in key] + [at], names=[*names, "no"])
        found = keys.group_by(names, use_threads=False).aggregate([("no", "first")])
        yield from table.take(found.column("no_first")).combine_chunks().to_batches()


def store_new_documents(
    documents: DataFrame, store: str, checkpoint: str, order: list[str], restart: bool = False
) -> StreamingQuery:
    """Adds documents whose key was never stored, with no limit on how far back that goes.

    The keys this run stored are kept in engine state in its checkpoint, so a micro-batch looks up only its own keys
    and never reads the store. A restart reads all input again and still skips what earlier runs stored: their keys
    are taken from the store once, when the run starts. The store is laid out by collection and year.

    Within a micro-batch a key's first row in ``order`` is the one stored: rows reach the engine's deduplication sorted,
    and it lets the first through. They are dealt by key to the parts of the state, so none are dealt anew in between.
    """
    spark, run, schema = documents.sparkSession, run_name(restart), documents.schema
    open_store(spark, store, run, schema, LAYOUT)
    earlier = read_store(spark, store, schema).where(F.col("run") != run).select(*KEY).distinct()
    earlier = None if earlier.isEmpty() else materialise(earlier, "earlier_keys")

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = batch if earlier is None else batch.join(earlier, KEY, "left_anti").select(*schema.names)
        # The engine runs stateful queries without adaptive plans, and without these nothing is rebalanced.
        with settings(batch.sparkSession, REBALANCED):
            write_batch(fresh, store, run, batch_id, LAYOUT)

    rows = usable(documents)
    thin = rows.mapInArrow(lambda batches: firsts(batches, KEY, order), rows.schema)
    parts = state_parts(spark, f"{checkpoint}/{run}")
    sorted_rows = thin.repartition(parts, *KEY).sortWithinPartitions(*KEY, *order)
    with settings(spark, state_settings(parts)):
        return (
            sorted_rows.dropDuplicates(KEY).writeStream.foreachBatch(store_batch)
            .option("checkpointLocation", f"{checkpoint}/{run}").trigger(availableNow=True).start()
        )


def ingest_stream(
    spark: SparkSession,
    src: str,
    out: str,
    checkpoint: str,
    restart: bool = False,
    files_per_batch: int | None = None,
    collection: Column | None = None,
) -> StreamingQuery:
    """Reads pages that are new since the last run and stores their documents.

    Progress is kept per file, so pages that arrive in front of older ones shift nothing.
    The collection is what the item names, or an expression over ``file`` and ``item``;
    the whole item is kept beside the key as JSON.
    """
    items = with_doc_key(explode_items(payload_stream(spark, src, files_per_batch)))
    named = F.try_element_at("item", F.lit("collection")) if collection is None else collection
    documents = items.select(
        "file", "idx", F.upper(named).alias("collection"), "year", "number", F.to_json("item").alias("metadata"),
    )
    return store_new_documents(documents, out, checkpoint, ["file", "idx"], restart)
