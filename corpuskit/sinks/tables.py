"""Staged tables, compaction, samples, reports and the document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import delete_folder, scratch_path
from corpuskit.sources.bulk_csv import ESCAPE
from corpuskit.sources.files import dataset_bytes, read_stage

GIB = 1 << 30
EMPTY_BZIP2 = 14
COPY_BYTES = 1 << 22


def write_stage(df: DataFrame, path: str, codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def file_plan(sizes: DataFrame, target_bytes: int = GIB) -> DataFrame:
    """Adds ``num_files``: total bytes over the target size, rounded up, at least one."""
    return sizes.withColumn(
        "num_files", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("bytes") / F.lit(target_bytes)))
    )


def compact(
    spark: SparkSession, src: str, dst: str, target_bytes: int = GIB, codec: str = "zstd"
) -> int:
    """Rewrite a staged table as files of about ``target_bytes``; returns their number.

    The scan already packs small files into even splits, so merging neighbouring splits
    needs no shuffle. Only where there are fewer splits than files wanted are rows
    redistributed.
    """
    n = file_plan(dataset_bytes(spark, src), target_bytes).first()["num_files"]
    staged = read_stage(spark, src)
    enough_splits = staged.rdd.getNumPartitions() >= n
    packed = staged.coalesce(n) if enough_splits else staged.repartition(n)
    write_stage(packed, dst, codec)
    return n


def write_summary_json(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON file; text outside ASCII is kept as it is."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sample(sample: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A sample to Parquet (zstd), or to CSV that reads back unchanged with ``\\N`` as null."""
    writer = sample.write.mode("overwrite")
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "csv":
        write_csv(sample, path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def write_csv(
    df: DataFrame, path: str, dialect: str = "doubled", null_value: str = "\\N", compression: str = "none", header: bool = True
) -> None:
    """CSV as the bulk reader expects it; the default trimming would eat control characters."""
    (
        df.write.mode("overwrite")
        .options(header=header, quote='"', escape=ESCAPE[dialect], nullValue=null_value)
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression=compression)
        .csv(path)
    )


def write_one_csv(df: DataFrame, path: str, **options) -> None:
    """`write_csv` as a single bzip2 file, compressed by the tasks of ``df``.

    Files of this format that follow one another are one file again, so the tasks' files are copied behind a header as they are.
    """
    spark = df.sparkSession
    parts = scratch_path(spark, "csv-parts")
    names = spark.createDataFrame([], df.schema).coalesce(1)
    write_csv(names, f"{parts}/header", compression="bzip2", **options)
    write_csv(df, f"{parts}/rows", compression="bzip2", header=False, **options)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    # Readers pass over the name it has until it is whole.
    target, begun = hadoop.fs.Path(f"{path}/part-00000.csv.bz2"), hadoop.fs.Path(f"{path}/_part-00000.csv.bz2")
    store = target.getFileSystem(conf)
    store.delete(target.getParent(), True)
    out = store.create(begun, True)
    try:
        for folder in ("header", "rows"):
            found = store.globStatus(hadoop.fs.Path(f"{parts}/{folder}/part-*"))
            for file in sorted(found, key=lambda file: file.getPath().getName()):
                if file.getLen() > EMPTY_BZIP2:
                    rows = store.open(file.getPath())
                    try:
                        hadoop.io.IOUtils.copyBytes(rows, out, COPY_BYTES, False)
                    finally:
                        rows.close()
    finally:
        out.close()
    store.rename(begun, target)
    delete_folder(spark, parts)


def write_documents(df: DataFrame, path: str, replace: bool = False) -> None:
    """Documents and their metadata, laid out by collection and year.

    ``rebalance`` lets the engine cut a collection-year that holds most rows into several
    files and merge the small ones. Appends by default; ``replace=True`` swaps out exactly
    the collection-years in ``df``. Either way readers see all of a write or none.
    """
    even = df.withColumn("collection", F.upper("collection")).hint("rebalance", "collection", "year")
    writer = even.write.partitionBy("collection", "year").option("compression", "zstd")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)
