"""Running totals over groups of any size, against plain Python."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import ordered
from corpuskit.operators.ordered import assign_batches, paged_listing, row_numbers, running_totals


@pytest.fixture(scope="module", autouse=True)
def several_ranges(spark):
    """Small test data would otherwise be merged into one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, many tiny groups, and a null group."""
    return spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("g"), F.col("id") % 700)).alias("g"),
        F.hash("id").alias("ts"), F.col("id").alias("id"), (F.col("id") % 5).alias("v"),
    ).repartition(6)


def expected_totals(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row.g].append((row.ts, row.id, row.v))
    out = {}
    for members in groups.values():
        total = 0
        for ts, i, v in sorted(members):
            total += v
            out[i] = total
    return out


def test_running_totals(spark, skewed):
    got = running_totals(skewed, ["g"], [F.asc("ts"), F.asc("id")], {"total": F.col("v")})
    assert {r.id: r.total for r in got.collect()} == expected_totals(skewed.collect())


def test_hot_group_spreads_over_ranges(spark, skewed, monkeypatch):
    written = []
    real = ordered.materialise
    monkeypatch.setattr(ordered, "materialise", lambda df, label: written.append(real(df, label)) or written[-1])
    running_totals(skewed, ["g"], [F.asc("ts"), F.asc("id")], {"total": F.col("v")}).count()
    sizes = [r["count"] for r in written[0].groupBy(ordered.PART).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 15_000
    hot = written[0].where("g = 'hot'").select(ordered.PART).distinct().count()
    assert hot >= 2


def test_no_single_task_window(spark, skewed):
    plan = running_totals(skewed, ["g"], [F.asc("id")], {"total": F.col("v")})._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("first", [None, 7, 5_000])
def test_row_numbers(spark, skewed, first):
    got = row_numbers(skewed, ["g"], [F.desc("ts"), F.asc("id")], "n", first)
    groups = defaultdict(list)
    for row in skewed.collect():
        groups[row.g].append((-row.ts, row.id))
    expected = {i: n for members in groups.values() for n, (_, i) in enumerate(sorted(members), 1)
                if first is None or n <= first}
    assert {r.id: r.n for r in got.collect()} == expected
    assert dict(got.dtypes)["n"] == "bigint"


def test_batches_and_pages(spark):
    rows = spark.range(45).select(F.lit("c").alias("c"), "id")
    batches = assign_batches(rows, ["c"], [F.asc("id")], 20).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in batches] == [(0, 20), (1, 20), (2, 5)]
    pages = paged_listing(rows, ["c"], [F.desc("id")], 20, max_pages=2)
    assert pages.count() == 40
    assert pages.where("id = 44").select("page", "idx").first() == (1, 0)
    assert pages.where("id = 5").select("page", "idx").first() == (2, 19)


def test_empty_input(spark, skewed):
    assert running_totals(skewed.limit(0), ["g"], [F.asc("id")], {"t": F.lit(1)}).count() == 0
