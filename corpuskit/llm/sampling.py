"""Samples by hash whose expected size is bounded at any number of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fine enough for a few rows of 10^17.
GRID = 1 << 60


def threshold(wanted: int, rows: int) -> int:
    """Of ``GRID`` hash values those below this one are picked, so that about ``wanted`` of ``rows`` are."""
    return GRID if rows <= wanted else wanted * GRID // rows


def picked(keys: list[str | Column], wanted: int, rows: int) -> Column:
    """Whether a row is in the sample of about ``wanted`` of ``rows``, by the hash of its keys; equal keys go together."""
    return F.pmod(F.xxhash64(*keys), F.lit(GRID)) < threshold(wanted, rows)
