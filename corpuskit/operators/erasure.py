"""Removal of all rows of the subjects who ask for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUE_BUSINESS_DAYS = 14


def business_days_after(day: Column, n: int) -> Column:
    """The ``n``-th day after ``day`` that is neither Saturday nor Sunday; holidays are not known."""
    later = F.sequence(F.date_add(day, 1), F.date_add(day, n + 2 * (n // 5 + 2)))
    return F.element_at(F.filter(later, lambda d: ~F.dayofweek(d).isin(1, 7)), n)


def erase_subjects(
    df: DataFrame, requests: DataFrame, subject: str, asked_on: str = "asked_on", due_days: int = DUE_BUSINESS_DAYS
) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and a receipt per subject: when it first asked, when that is due, how many rows go.

    Subjects without any row get a receipt too. Rows without subject stay.
    """
    asked = requests.where(F.col(subject).isNotNull()).groupBy(subject).agg(F.min(asked_on).cast("date").alias("asked_on"))
    kept = df.join(asked.select(subject), subject, "left_anti")
    # Counted per subject before the join, so a subject with very many rows is one row in it.
    counts = df.groupBy(subject).agg(F.count(F.lit(1)).alias("rows_erased"))
    receipts = asked.join(counts, subject, "left").select(
        subject, "asked_on", business_days_after(F.col("asked_on"), due_days).alias("due_on"),
        F.coalesce("rows_erased", F.lit(0)).alias("rows_erased"))
    return kept, receipts
