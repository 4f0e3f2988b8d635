"""Staged tables: scan, size, shape and a first look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stage(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def data_files(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per data file: name, path and size. Lists files, opens none of them."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
        .select(F.col("_metadata.file_name").alias("file_name"), "path", F.col("length").alias("bytes"))
    )


def dataset_bytes(spark: SparkSession, *paths: str) -> DataFrame:
    """On-disk size and file count of a data set."""
    return data_files(spark, *paths).agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files")
    )


def describe_columns(df: DataFrame) -> DataFrame:
    """A row per column: position, name, type, and the shape of the whole table."""
    columns = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"))
        for i, f in enumerate(df.schema.fields)
    ])
    return (
        df.agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.inline(columns), F.col("row_count"), F.lit(len(df.columns)).alias("column_count"))
    )


def head_rows(df: DataFrame, n: int, *key: str | Column) -> DataFrame:
    """First ``n`` rows in key order."""
    return df.orderBy(*key).limit(n)


def raw_head(spark: SparkSession, path: str, n: int = 3) -> DataFrame:
    """First ``n`` non-empty raw lines with their line number, files in path order.

    ``take`` opens the front of a file first and stops early, so a peek does not scan
    the data; only ``n`` lines come to the driver.
    """
    found: list[tuple[str, int, str]] = []
    for file in sorted(spark.read.text(path).inputFiles()):
        lines = spark.read.option("lineSep", "\n").text(file).select(
            "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")
        )
        rows = lines.where(F.length("value") > 0).take(n - len(found))
        offsets: dict[int, int] = {}
        if any(row.part for row in rows):
            seen = 0
            for row in lines.groupBy("part").count().orderBy("part").collect():
                offsets[row["part"]] = seen
                seen += row["count"]
        found += [(file, offsets.get(r.part, 0) + (r.id & ((1 << 33) - 1)) + 1, r.value) for r in rows]
        if len(found) >= n:
            break
    return spark.createDataFrame(found, "file string, line_no long, line string")
