"""Tables that grow by one folder per micro-batch.

Batch N of a run writes ``run=R/batch=N`` and reads only what came before it. A batch that
is run again after a failure replaces its own folder, so its effect is the same as once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


ENGINE_STATE = "spark.sql.streaming.stateStore.providerClass"
SHUFFLE_PARTS = "spark.sql.shuffle.partitions"
# A batch is cut where one folder holds most of it, and not merged into one task where it is small.
REBALANCED = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_engine_state(spark: SparkSession) -> None:
    """Lets queries that are started from now on keep state in RocksDB, on the executors' disks and in the checkpoint."""
    spark.conf.set(ENGINE_STATE, ROCKS_DB)


def state_parts(spark: SparkSession, checkpoint: str) -> int:
    """Parts a query keeps its state in: those its checkpoint began with, which the engine holds on to; at first one a core,
    unless fewer are set."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        begun = F.get_json_object("value", f"$['conf']['{SHUFFLE_PARTS}']").cast("int")
        if found := spark.read.schema("value string").text(f"{checkpoint}/offsets").agg(F.max(begun)).first()[0]:
            return found
    return min(int(spark.conf.get(SHUFFLE_PARTS)), spark.sparkContext.defaultParallelism)


def state_settings(parts: int) -> dict[str, str]:
    """For cheap micro-batches of a query with state: it is in RocksDB, in ``parts`` parts, and a commit adds the changes.
    Rows may be sorted within the parts."""
    return {
        ENGINE_STATE: ROCKS_DB, SHUFFLE_PARTS: str(parts),
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # The check refuses any sort of a stream, though one within the partitions of a micro-batch is sound.
        "spark.sql.streaming.unsupportedOperationCheck": "false",
    }


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Holds session settings inside the block; a streaming query keeps those it was started under."""
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def millis_of(interval: str) -> int:
    """Length of a day-time interval such as "90 minutes"."""
    found = re.findall(r"(\d+)\s*(second|minute|hour|day|week)s?", interval)
    if not found or re.sub(r"(\d+)\s*(second|minute|hour|day|week)s?|\s", "", interval):
        raise ValueError(f"no interval of weeks to seconds: {interval!r}")
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
    return 1000 * sum(int(n) * seconds[unit] for n, unit in found)


def run_name(restart: bool) -> str:
    """Name of the run to go on with, or of a fresh one that reads every file again."""
    return f"r{uuid.uuid4().hex}" if restart else "main"


def batch_path(root: str, run: str, batch_id: int) -> str:
    return f"{root}/run={run}/batch={batch_id}"


def write_batch(df: DataFrame, root: str, run: str, batch_id: int, by: Sequence[str] = ()) -> None:
    """Writes a batch, laid out by the columns ``by``; a full one of these gets several files."""
    rows = df.hint("rebalance", *by) if by else df
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(batch_path(root, run, batch_id))


def open_store(spark: SparkSession, root: str, run: str, schema: StructType, by: Sequence[str] = ()) -> None:
    """An empty batch in front of the first one, so that there is always one to read."""
    write_batch(spark.createDataFrame([], schema), root, run, -1, by)


def read_store(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All batches of all runs, with their ``run`` and ``batch``."""
    keys = [StructField("run", StringType()), StructField("batch", LongType())]
    return spark.read.schema(StructType([*schema.fields, *keys])).parquet(root)


def read_latest(spark: SparkSession, root: str, run: str, schema: StructType) -> DataFrame:
    """The last batch of a run, for stores whose batches hold the whole state."""
    versions = read_store(spark, root, schema).where(F.col("run") == run)
    last = versions.agg(F.max("batch")).first()[0]
    return versions.where(F.col("batch") == (-1 if last is None else last)).drop("run", "batch")
