"""Quantiles of a table that grows, from stored sketches of its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ranks are off by some 0.4 percent; a sketch has a few kilobytes, however many rows it stands for.
SKETCH_SIZE = 800
RANK_ERROR = 0.01


def add_sketches(df: DataFrame, value: Column, part: Column, path: str, size: int = SKETCH_SIZE) -> None:
    """Appends a sketch per ``part`` (a day, a file) of new rows to the sketches stored at ``path``. Null values do not count.

    Rows become sketches within tasks; what is shuffled are sketches, so a part with most rows does not gather them.
    """
    sketches = df.where(value.isNotNull()).groupBy(part.cast("string").alias("part")).agg(
        F.kll_sketch_agg_bigint(value.cast("bigint"), size).alias("sketch"))
    sketches.write.mode("append").parquet(path)


def sketched_quantiles(spark: SparkSession, path: str, quantiles: list[float], by: Column | None = None) -> DataFrame:
    """Rows (``q``, ``value``, ``n``) from all stored sketches, or from those of each value of ``by``, an expression over ``part``.

    No row of the data is read again. ``value`` is one of the data whose rank is ``q`` up to `RANK_ERROR` of all rows.
    """
    stored = spark.read.parquet(path)
    merged = stored.groupBy(*([] if by is None else [by.alias("by")])).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    n = F.kll_sketch_get_n_bigint("sketch").alias("n")
    each = [F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias("value"), n) for q in quantiles]
    return merged.where(F.kll_sketch_get_n_bigint("sketch") > 0).select(*([] if by is None else ["by"]), F.inline(F.array(*each)))


def rank_errors(df: DataFrame, value: Column, quantiles: DataFrame) -> DataFrame:
    """``quantiles`` with ``off``: by what share of the rows of ``df`` each value's rank misses ``q``, 0 where equal values hold it."""
    asked = quantiles.select("q", "value").collect()  # a row per quantile
    counts = df.where(value.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(value < r.value).alias(f"below{i}") for i, r in enumerate(asked)],
        *[F.count_if(value <= r.value).alias(f"upto{i}") for i, r in enumerate(asked)])
    each = F.inline(F.array(*[F.struct(F.lit(r.q).alias("q"), F.lit(r.value).cast("bigint").alias("value"), F.col(f"below{i}").alias("below"), F.col(f"upto{i}").alias("upto")) for i, r in enumerate(asked)]))
    ranks = counts.select("n", each)
    miss = F.greatest(F.lit(0.0), F.col("below") - F.col("q") * F.col("n"), F.col("q") * F.col("n") - F.col("upto")) / F.col("n")
    return ranks.select("q", "value", "n", miss.alias("off"))
