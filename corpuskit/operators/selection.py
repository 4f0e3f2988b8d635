"""Exact quantiles of a column with any number of different values, by distributed selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1024
FEW_ROWS = 10_000


def values_at(df: DataFrame, value: Column, ranks: list[int]) -> dict[int, float]:
    """Values at 0-based ``ranks`` among the non-null values, in double precision.

    The range that holds a rank is cut into ``CELLS`` cells, tasks count what falls into them, and the cell with the rank, from its
    least to its greatest value, is the next range. When a range holds few rows, or one value, it is done. All ranks
    share the passes; each brings a row per cell and rank to the driver, never the values, and no task sorts or holds them.
    NaN is greater than all other values.
    """
    numbers = df.select(value.cast("double").alias("v")).where("v is not null")
    whole = numbers.where(~F.isnan("v")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    found = {r: math.nan for r in ranks if r >= whole.n}
    # By rank: rows before the range, the range, rows in it.
    open_ = {r: (0, whole.low, whole.high, whole.n) for r in ranks if r < whole.n}
    while open_:
        found |= {r: low for r, (_, low, high, _) in open_.items() if low == high}
        open_ = {r: x for r, x in open_.items() if r not in found}
        ranges = sorted({x for x in open_.values()})
        small = [x for x in ranges if x[3] <= FEW_ROWS]
        if small:
            within = numbers.where(" or ".join(f"v between double('{low!r}') and double('{high!r}')" for _, low, high, _ in small))
            counts = within.groupBy("v").count().collect()  # at most FEW_ROWS values of each range
            for r, (before, low, high, n) in open_.items():
                if n <= FEW_ROWS:
                    at = before
                    for v, c in sorted((x.v, x["count"]) for x in counts if low <= x.v <= high):
                        at += c
                        if r < at:
                            found[r] = v
                            break
            open_ = {r: x for r, x in open_.items() if r not in found}
            continue
        cells = []
        for i, (_, low, high, _) in enumerate(ranges):
            # Halved, so that the width of the range of all doubles is a number.
            share = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2)
            cells.append(F.when(F.col("v").between(low, high), F.struct(F.lit(i).alias("range"), F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).alias("cell"))))
        each = numbers.select("v", F.explode(F.array_compact(F.array(*cells))).alias("at")) if ranges else None
        rows = each.groupBy("at").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect() if ranges else []
        for r, (before, low, high, n) in open_.items():
            number = ranges.index((before, low, high, n))
            for row in sorted((x for x in rows if x["at"]["range"] == number), key=lambda x: x["at"]["cell"]):
                if r < before + row.n:
                    open_[r] = (before, row.low, row.high, row.n)
                    break
                before += row.n
    return found


def exact_percentiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Percentiles between the two nearest values, as `pyspark.sql.functions.percentile` gives them; None without values."""
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * p for p in shares]
    at = values_at(df, value, sorted({int(f(x)) for x in places for f in (math.floor, math.ceil)}))
    out = []
    for x in places:
        low, high = at[math.floor(x)], at[math.ceil(x)]
        out.append(low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high)
    return out
