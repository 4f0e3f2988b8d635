"""Endpoint lists in mixed notations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.requests import normalise_endpoint
from corpuskit.functions.text import strip


def normalise_endpoints(lines: DataFrame, line: str = "line") -> DataFrame:
    """Blank and ``#`` lines go; the rest gain ``endpoint`` and ``valid``."""
    text = strip(F.col(line))
    return (
        lines.where((F.length(text) > 0) & ~text.startswith("#"))
        .withColumn("endpoint", normalise_endpoint(F.col(line)))
        .withColumn("valid", F.col("endpoint").isNotNull())
    )
