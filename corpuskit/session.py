"""Session defaults and the shared scratch folder that lineage is cut into."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Chosen once per application when the cluster names no shared folder (local mode only).
_local_roots: dict[str, str] = {}
# Copies written in the innermost ``temporary_copies`` block.
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one spark-submit provides."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpuskit")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temp folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_roots:
        root = tempfile.mkdtemp(prefix="corpuskit-")
        context.setCheckpointDir(root)
        _local_roots[context.applicationId] = root
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return f"{shared_root(spark).rstrip('/')}/corpuskit/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back.

    Unlike an RDD checkpoint the copy is compressed, column-prunable and carries
    file sizes that the optimizer can use. It outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if (block := _written.get()) is not None:
        block.append(path)
    df.write.option("compression", "zstd").parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._copy_path = path
    return copy


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder from whatever store it is in; nothing happens if it is gone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary_copies(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the copies that ``materialise`` writes inside, when the block ends.

    Those appended to the list stay, for results that are not computed yet read them; they belong to the
    block around this one, if there is one.
    """
    kept: list[DataFrame] = []
    outer = _written.get()
    token = _written.set([])
    try:
        yield kept
    except BaseException:
        kept.clear()
        raise
    finally:
        written = _written.get()
        _written.reset(token)
        staying = {df._copy_path for df in kept}
        for path in written:
            if path not in staying:
                delete_folder(spark, path)
            elif outer is not None:
                outer.append(path)
