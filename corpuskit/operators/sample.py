"""Samples that depend on row keys only, not on how the data is partitioned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ordered import row_numbers

HASH_RANGE = 1 << 32
CELL = 1 << 16


def key_hash(key: Column, seed: int = 42) -> Column:
    """32 uniform bits of a key; null keys share those of the empty one."""
    return F.conv(F.substring(_digest(key, seed), 1, 8), 16, 10).cast("bigint")


def _digest(key: Column, salt: int) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))))


def _threshold(pct: float) -> int:
    return round(max(0.0, min(100.0, pct)) / 100.0 * HASH_RANGE)


def is_sampled(key: Column, pct: float, seed: int = 42) -> Column:
    """True for about ``pct`` percent of keys, clamped to 0-100."""
    return key_hash(key, seed) < _threshold(pct)


def bernoulli_sample(
    df: DataFrame, key: str, pct: float = 2.5, cap: int | None = None, seed: int = 42, fallback: int = 0
) -> DataFrame:
    """About ``pct`` percent of the rows by hash of a unique ``key``.

    Past ``cap`` rows the ones with the lowest hash stay, which is a uniform sample of
    exactly ``cap`` rows. There is no cap unless one is given. An empty sample stays empty unless ``fallback`` asks for
    so many rows of the smallest keys instead.
    """
    hashed = df.withColumn("_hash", key_hash(F.col(key), seed)).where(F.col("_hash") < _threshold(pct))
    if fallback and hashed.isEmpty():
        return df.orderBy(key).limit(fallback)
    if cap is None:
        return hashed.drop("_hash")
    # At most 65,536 rows, whatever the size of the data.
    cells = (
        hashed.groupBy(F.floor(F.col("_hash") / CELL).alias("cell")).count().orderBy("cell").collect()
    )
    total = sum(row["count"] for row in cells)
    if total <= cap:
        return hashed.drop("_hash")

    kept = 0
    for row in cells:
        if kept + row["count"] > cap:
            border = row["cell"]
            break
        kept += row["count"]
    below = hashed.where(F.col("_hash") < border * CELL)
    # Rows of the border cell are ranked among themselves, about 1/65,536 of the range.
    in_border = hashed.where(F.floor(F.col("_hash") / CELL) == border).withColumn("_all", F.lit(0))
    ranked = row_numbers(in_border, ["_all"], [F.col("_hash").asc(), F.col(key).asc()], "_rank")
    chosen = ranked.where(F.col("_rank") <= cap - kept)
    return union_parts([below.drop("_hash"), chosen.drop("_hash", "_all", "_rank")])


def random_rows(df: DataFrame, key: str, n: int = 5, salt: int = 7) -> DataFrame:
    """``n`` rows in random but repeatable order, all rows if there are no more."""
    return df.orderBy(_digest(F.col(key), salt), key).limit(n)


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, columns matched by name."""
    return reduce(DataFrame.unionByName, parts)
