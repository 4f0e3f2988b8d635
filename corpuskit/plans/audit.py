"""Audit of a bulk CSV, or of a table staged from one, to a JSON report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from corpuskit.functions.columns import EXPECTED_COLUMNS
from corpuskit.operators.audit import audit_summary
from corpuskit.sinks.tables import write_summary_json
from corpuskit.sources.bulk_csv import read_bulk_csv
from corpuskit.sources.files import read_stage


def run_audit(
    spark: SparkSession,
    src: str,
    out: str,
    staged: bool = False,
    expected: Sequence[str] = EXPECTED_COLUMNS,
    key: str = "id",
) -> DataFrame:
    """Writes the report to ``out`` and returns it as it was written.

    A CSV file is scanned once, in one task per file; stage large ones with `run_etl` first
    and audit the result with ``staged=True``.
    """
    rows = read_stage(spark, src) if staged else read_bulk_csv(spark, src)
    report = audit_summary(rows, expected=expected, key=key, source=src)
    write_summary_json(report, out)
    return spark.read.schema(report.schema).json(out)
