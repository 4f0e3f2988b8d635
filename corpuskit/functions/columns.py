"""Decisions about column names, taken on the driver from the schema alone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names of the bulk opinions data set.
EXPECTED_COLUMNS = [
    "id", "date_created", "date_modified", "author_str", "per_curiam", "joined_by_str",
    "type", "sha1", "page_count", "download_url", "local_path", "plain_text", "html",
    "html_lawbox", "html_columbia", "html_anon_2020", "xml_harvard", "html_with_citations",
    "extracted_by_ocr", "author_id", "cluster_id", "precedential_status",
]
TEXT_CANDIDATES = ["plain_text", "html_with_citations", "html", "absolute_html", "absolute_html_lawbox"]
METADATA_WISHLIST = [
    "id", "cluster_id", "court_id", "date_filed", "type", "author_id", "per_curiam",
    "judge_id", "source", "resource_uri", "absolute_url",
]


def quoted(name: str) -> str:
    """A header name as an identifier, whatever characters it is made of."""
    return "`" + name.replace("`", "``") + "`"


def missing_columns(df: DataFrame, expected: Iterable[str] = EXPECTED_COLUMNS) -> list[str]:
    """Expected names the frame lacks, in expected order; blank names are skipped."""
    present = set(df.columns)
    return [name for name in expected if name and name not in present]


def missing_columns_literal(df: DataFrame, expected: Iterable[str] = EXPECTED_COLUMNS) -> Column:
    """`missing_columns` as an ``array<string>`` column, for reports."""
    return F.array(*[F.lit(name) for name in missing_columns(df, expected)]).cast("array<string>")


def present_of(df: DataFrame, wishlist: Iterable[str] = METADATA_WISHLIST) -> list[str]:
    """Names of the wishlist the frame has, in wishlist order."""
    present = set(df.columns)
    return [name for name in wishlist if name in present]


def first_present(df: DataFrame, candidates: Iterable[str] = TEXT_CANDIDATES) -> str | None:
    """First candidate the frame has, or None."""
    return next(iter(present_of(df, candidates)), None)
