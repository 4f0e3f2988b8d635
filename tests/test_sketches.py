"""Quantiles from stored sketches: what is read, and how far ranks are off."""

import pytest
from pyspark.sql import functions as F

from corpuskit.operators.sketches import RANK_ERROR, add_sketches, rank_errors, sketched_quantiles

QUANTILES = [0.0, 0.1, 0.5, 0.9, 0.99, 0.999, 1.0]


def test_merged_sketches_keep_their_rank_error(spark, folder):
    df = spark.range(120_000).select(F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("v"), (F.col("id") % 30).alias("day"))
    for load in range(3):
        add_sketches(df.where(F.col("day") % 3 == load), F.col("v"), F.col("day"), folder + "/s")
    assert spark.read.parquet(folder + "/s").count() == 30
    found = sketched_quantiles(spark, folder + "/s", QUANTILES)
    checked = rank_errors(df, F.col("v"), found).collect()
    assert sorted(r.q for r in checked) == QUANTILES and all(r.n == 120_000 and r.off <= RANK_ERROR for r in checked)
    days = sketched_quantiles(spark, folder + "/s", [0.5], by=F.col("part")).collect()
    assert len(days) == 30 and all(r.n == 4_000 for r in days)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "sketch" in plan


def test_ties_nulls_and_nothing(spark, folder):
    rows = [(5, "a")] * 50 + [(None, "a"), (7, None)]
    df = spark.createDataFrame(rows, "v bigint, part string")
    add_sketches(df, F.col("v"), F.col("part"), folder + "/s")
    got = {r.q: (r.value, r.n) for r in sketched_quantiles(spark, folder + "/s", [0.5, 1.0]).collect()}
    assert got == {0.5: (5, 51), 1.0: (7, 51)}
    add_sketches(df.where("v is null"), F.col("v"), F.col("part"), folder + "/none")
    with pytest.raises(Exception):
        sketched_quantiles(spark, folder + "/missing", [0.5])
    assert sketched_quantiles(spark, folder + "/none", [0.5]).count() == 0
