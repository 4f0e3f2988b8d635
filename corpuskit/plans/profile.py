"""Sample a table and profile the sample."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpuskit.functions.columns import first_present, present_of
from corpuskit.operators.audit import top_values
from corpuskit.operators.profile import date_range, empty_count, exact_quantiles, null_rates
from corpuskit.operators.sample import bernoulli_sample, random_rows
from corpuskit.session import materialise
from corpuskit.sinks.tables import write_sample


def run_profile(
    df: DataFrame,
    key: str = "id",
    pct: float = 2.5,
    cap: int | None = None,
    out: str | None = None,
    outfmt: str = "parquet",
) -> dict[str, DataFrame]:
    """The parts of the profile by name; columns the table lacks leave their part out.

    The table is sampled once; the sample is kept in the shared folder for all parts,
    and written to ``out`` for others if that is given.
    """
    sample = materialise(bernoulli_sample(df, key, pct, cap), "sample")
    if out:
        write_sample(sample, out, outfmt)
    text, metadata = first_present(sample), present_of(sample)
    parts = {"sample": sample, "head": sample.orderBy(key).limit(5), "random": random_rows(sample, key)}
    if metadata or text:
        parts["null_rates"] = null_rates(sample, metadata + [c for c in [text] if c])
    if text:
        parts["lengths"], parts["empty"] = exact_quantiles(sample, text), empty_count(sample, text)
    if "date_filed" in sample.columns:
        parts["dates"] = date_range(sample, "date_filed")
    if "court_id" in sample.columns:
        parts["courts"] = top_values(sample, "court_id")
    return parts
