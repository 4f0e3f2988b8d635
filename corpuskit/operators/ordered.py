"""Running totals within groups, however large a group is.

A window over a group runs in one task per group. Here rows are cut into even ranges of
(group, order), so that a group holding most rows spreads over many tasks; each range is
totalled on its own and then shifted by what comes before it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.session import materialise

PART = "_range"
SPLITS = 64


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    measures: dict[str, Column],
) -> DataFrame:
    """Adds inclusive running sums of ``measures`` per ``group`` in ``order``.

    ``order`` must be unique within a group. Pass narrow rows and join wide columns back on.
    """
    staged = df.select("*", *[value.cast("bigint").alias(name) for name, value in measures.items()])
    columns, measures = df.columns, list(measures)
    # Range borders are sampled anew each time the plan runs; the written copy pins them.
    ranged = staged.repartitionByRange(*[F.col(c).asc() for c in group], *order)
    ranged = materialise(ranged.withColumn(PART, F.spark_partition_id()), "ranges")

    in_range = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(PART, *group).agg(*[F.sum(name).alias(name) for name in measures])
        .select(PART, *group, *[F.sum(name).over(earlier).alias(f"_before_{name}") for name in measures])
        .where(reduce(and_, [F.col(f"_before_{name}").isNotNull() for name in measures]))
    )
    # Ranges are contiguous, so at most one group per range began in an earlier one: the
    # table has no more rows than there are ranges.
    small = F.broadcast(shifts.select(F.col(PART).alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group],
                                      *[f"_before_{name}" for name in measures]))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group], F.col(PART) == F.col("_p"))
    local = ranged.withColumns({name: F.sum(name).over(in_range) for name in measures})
    return local.join(small, same, "left").select(
        *columns,
        *[(F.col(name) + F.coalesce(F.col(f"_before_{name}"), F.lit(0))).alias(name) for name in measures],
    )


def row_numbers(
    df: DataFrame, group: list[str], order: list[Column], name: str = "row_no", first: int | None = None
) -> DataFrame:
    """Adds the 1-based position of each row within its group; ``first`` keeps that many per group."""
    return running_totals(df, group, order, {name: F.lit(1)}) if first is None else first_rows(df, group, order, name, first)


def first_rows(df: DataFrame, group: list[str], order: list[Column], name: str, first: int) -> DataFrame:
    """The first rows of each group with their positions, without sorting the others.

    Tasks cut what they read to ``first`` rows a group before anything is shuffled, and so does each of ``SPLITS`` parts of
    a group, so at most ``SPLITS`` times ``first`` rows of a group meet in one task, however large it is.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    split = df.withColumn(PART, F.spark_partition_id() % SPLITS)
    few = split.withColumn(name, place(*group, PART)).where(F.col(name) <= first).drop(name, PART)
    return few.withColumn(name, place(*group).cast("bigint")).where(F.col(name) <= first)


def assign_batches(df: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """Adds the 0-based ``batch`` of fixed ``size`` a row belongs to, and its ``position`` there."""
    at = F.col("_row_no") - 1
    return row_numbers(df, group, order, "_row_no").select(
        *df.columns, F.floor(at / size).alias("batch"), (at % size).alias("position")
    )


def paged_listing(
    df: DataFrame, group: list[str], order: list[Column], size: int = 100, max_pages: int | None = None
) -> DataFrame:
    """Adds the 1-based ``page`` and the 0-based ``idx`` on it."""
    at = F.col("_row_no") - 1
    first = size * max_pages if max_pages else None
    return row_numbers(df, group, order, "_row_no", first).select(
        *df.columns, (F.floor(at / size) + 1).alias("page"), (at % size).alias("idx")
    )
