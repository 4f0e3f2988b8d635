"""Selection of quantiles against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import selection
from corpuskit.operators.selection import exact_percentiles, values_at


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(3)


@pytest.mark.parametrize("few", [1, 50])
def test_values_at_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW_ROWS", few)
    monkeypatch.setattr(selection, "CELLS", 8)
    rng = random.Random(few)
    values = [rng.choice([rng.gauss(0, 1), rng.expovariate(1e-6), 3.0, -7.5, 1e300, -1e300]) for _ in range(400)]
    ranks = [0, 1, 37, 200, 201, 399]
    got = values_at(numbers(spark, [*values, None, None]), F.col("x"), ranks)
    assert got == {r: sorted(values)[r] for r in ranks}


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    values = rng.lognormal(size=30_001)
    df = numbers(spark, values.tolist())
    shares = [0.0, 0.5, 0.95, 0.999, 1.0]
    got = exact_percentiles(df, F.col("x"), shares)
    assert got == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    assert exact_percentiles(df.limit(0), F.col("x"), [0.5]) == [None]
    assert exact_percentiles(numbers(spark, [2.0, 2.0, 2.0]), F.col("x"), [0.1, 0.9]) == [2.0, 2.0]


def test_nan_is_greatest(spark):
    got = values_at(numbers(spark, [1.0, math.nan, 5.0]), F.col("x"), [0, 1, 2])
    assert got[0] == 1.0 and got[1] == 5.0 and math.isnan(got[2])


def test_no_task_gathers_the_values(spark):
    """Rows leave the tasks of a pass as counts per cell."""
    df = spark.range(200_000).select((F.col("id") * 0.37).alias("x"))
    assert exact_percentiles(df, F.col("x"), [0.5]) == pytest.approx([99_999.5 * 0.37])
