"""Profile of a table or of a sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.columns import quoted
from corpuskit.functions.dates import DATE_FORMATS, parse_date_or_null
from corpuskit.functions.text import text_length

PROFILE_QUANTILES = [0.5, 0.9, 0.99]


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Percentage of nulls per column, two decimals, highest first; empty text is not null."""
    names = columns or df.columns
    one_row = df.agg(*[F.avg(F.col(quoted(c)).isNull().cast("int")).alias(c) for c in names])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.round(F.col(quoted(c)) * 100, 2).alias("null_pct")) for c in names
    ])
    return one_row.select(F.inline(pairs)).orderBy(F.desc_nulls_last("null_pct"), "column_name")


def exact_quantiles(df: DataFrame, column: str, quantiles: list[float] = PROFILE_QUANTILES) -> DataFrame:
    """Interpolated length quantiles cut to integers, a null text counting as length 0.

    Rows are counted per length before the quantiles are taken, so what reaches the
    last task grows with the longest text and not with the number of rows.
    """
    counts = df.groupBy(text_length(F.col(column), 0).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    exact = counts.agg(F.percentile("length", quantiles, F.col("n")).alias("q"))
    # Interpolation may land a float's breadth under a whole number.
    return exact.select(*[
        F.floor(F.round(F.get("q", F.lit(i)), 6)).alias(f"p{int(q * 100)}") for i, q in enumerate(quantiles)
    ])


def empty_count(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is null or empty."""
    return df.agg(
        F.count_if(text_length(F.col(column), 0) == 0).alias("empty"), F.count(F.lit(1)).alias("row_count")
    )


def date_range(df: DataFrame, column: str, formats: list[str] = DATE_FORMATS) -> DataFrame:
    """Earliest and latest date, and rows without a readable one."""
    date = parse_date_or_null(F.col(column), formats)
    return df.select(date.alias("d")).agg(
        F.min("d").alias("min_date"), F.max("d").alias("max_date"), F.count_if(F.col("d").isNull()).alias("null_dates")
    )


def sample_report(df: DataFrame, taken: Column) -> DataFrame:
    """Rows scanned and rows sampled, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(taken).alias("sampled"))
