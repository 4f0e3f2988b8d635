"""Dates in text and in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]


def parse_date_or_null(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """First format that fits wins; anything else is null, never an error."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt in formats])


def snapshot_date(name: Column) -> Column:
    """``opinions-YYYY-MM-DD…`` to its date; other names come back unchanged."""
    date = F.regexp_extract(name, r"^opinions-([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.when(date != "", date).otherwise(name)


def gib(size: Column) -> Column:
    """Bytes as GiB text with one decimal."""
    return F.format_string("%.1f", size / F.lit(float(1 << 30)))
