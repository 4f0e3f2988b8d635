"""Bulk CSV to compacted Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from corpuskit.session import scratch_path
from corpuskit.sinks.tables import GIB, compact, write_stage
from corpuskit.sources.bulk_csv import read_bulk_csv


@dataclass
class EtlOptions:
    dialect: str = "doubled"
    header: bool = True
    permissive: bool = True
    null_value: str | None = None
    codec: str = "zstd"
    target_bytes: int = GIB
    stage: str | None = None


def run_etl(spark: SparkSession, src: str, out: str, options: EtlOptions | None = None) -> int:
    """Reads CSV, stages it as Parquet and compacts that; returns the number of files.

    A file is read by one task, so a large export is best landed as several files. ``stage`` keeps the uncompacted copy at a path of yours.
    """
    o = options or EtlOptions()
    rows = read_bulk_csv(spark, src, o.dialect, o.header, mode="PERMISSIVE" if o.permissive else "FAILFAST",
                         null_value=o.null_value)
    stage = o.stage or scratch_path(spark, "stage")
    write_stage(rows, stage, o.codec)
    return compact(spark, stage, out, o.target_bytes, o.codec)
