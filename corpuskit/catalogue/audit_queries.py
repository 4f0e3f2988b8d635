"""Audit, profile and sample queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corpuskit.catalogue.views import table, view, with_views
from corpuskit.functions.columns import EXPECTED_COLUMNS
from corpuskit.functions.dates import parse_date_or_null
from corpuskit.functions.text import is_nullish, length_bucket, text_length
from corpuskit.operators import audit, profile, sample, sketches
from corpuskit.plans.profile import run_profile
from corpuskit.session import scratch_path

TEXTS = ["plain_text", "html_with_citations"]
# Fixed value: the control-character class, in DuckDB's spelling.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def audit_counts(spark, sf_dir):
    return audit.audit_counts(view(spark, sf_dir, "opinions"), TEXTS)


def row_flags(spark, sf_dir):
    return view(spark, sf_dir, "opinions").select(
        "id", *[is_nullish(F.col(c)).alias(f"nullish_{c}") for c in TEXTS],
        length_bucket(text_length(F.col("plain_text"))).alias("bucket"),
        length_bucket(text_length(F.col("plain_text")), strict=True).alias("strict_bucket"),
        parse_date_or_null(F.col("date_filed")).cast("date").alias("filed"),
    )


def audit_quantiles_exact(spark, sf_dir):
    return profile.exact_quantiles(view(spark, sf_dir, "opinions"), "plain_text")


def audit_quantiles_approx(spark, sf_dir):
    quantiles = audit.discrete_quantiles(
        view(spark, sf_dir, "opinions"), text_length(F.col("plain_text")), audit.AUDIT_QUANTILES)
    return quantiles.select(
        *[F.get("quantiles", F.lit(i)).cast("bigint").alias(name) for i, name in enumerate(["p50", "p90", "p99", "p99_9"])])


def quantiles_from_sketches(spark, sf_dir):
    """Lengths of a table that was sketched in two loads, by court; the ranks of the answers are checked on the rows."""
    opinions, path = view(spark, sf_dir, "opinions"), scratch_path(spark, "sketches")
    length = F.length("plain_text")
    for load in (0, 1):
        sketches.add_sketches(opinions.where(F.col("id") % 2 == load), length, F.col("court_id"), path)
    found = sketches.sketched_quantiles(spark, path, audit.AUDIT_QUANTILES)
    checked = sketches.rank_errors(opinions, length, found)
    return checked.select("q", "n", (F.col("off") <= sketches.RANK_ERROR).alias("close"))


def length_histogram(spark, sf_dir):
    return audit.length_histogram(view(spark, sf_dir, "opinions"), text_length(F.col("plain_text")))


def length_histogram_strict(spark, sf_dir):
    return audit.length_histogram(view(spark, sf_dir, "opinions"), text_length(F.col("plain_text")), strict=True)


def longest_rows(spark, sf_dir):
    return audit.longest_rows(view(spark, sf_dir, "opinions"), "plain_text")


def control_char_examples(spark, sf_dir):
    return audit.control_char_examples(view(spark, sf_dir, "opinions"), "plain_text")


def null_rates(spark, sf_dir):
    return profile.null_rates(view(spark, sf_dir, "opinions"))


def empty_counts(spark, sf_dir):
    return profile.empty_count(view(spark, sf_dir, "opinions"), "plain_text")


def date_range(spark, sf_dir):
    return profile.date_range(view(spark, sf_dir, "opinions"), "date_filed").select(
        F.col("min_date").cast("date").alias("min_date"), F.col("max_date").cast("date").alias("max_date"), "null_dates")


def top_courts_keep_null(spark, sf_dir):
    return audit.top_values(view(spark, sf_dir, "opinions"), "court_id")


def top_courts_drop_null(spark, sf_dir):
    return audit.top_values(view(spark, sf_dir, "opinions"), "court_id", keep_null=False)


def top_types(spark, sf_dir):
    return audit.top_values(view(spark, sf_dir, "opinions"), "type")


def audit_summary(spark, sf_dir):
    """The whole report, a row per figure."""
    return audit.audit_figures(audit.audit_summary(view(spark, sf_dir, "opinions")))


def audit_summary_flat(spark, sf_dir):
    """The report's figures in one flat row, so that SQL can check them."""
    s = audit.audit_summary(view(spark, sf_dir, "opinions"))
    return s.select(
        "total_rows", F.size("missing_expected_columns").cast("bigint").alias("missing_columns"), "missing_all",
        *[F.col(f"missing.{c}").alias(f"missing_{c}") for c in TEXTS],
        *[F.col(f"lengths.{c}.p50").cast("bigint").alias(f"p50_{c}") for c in TEXTS],
        *[F.col(f"lengths.{c}.p99_9").cast("bigint").alias(f"p99_9_{c}") for c in TEXTS],
        *[F.col(f"control_chars.{c}.count").alias(f"control_{c}") for c in TEXTS],
        F.col("lengths.plain_text.buckets")["<=1k"].alias("short_plain_text"),
        F.col("lengths.plain_text.longest")[0]["length"].cast("bigint").alias("longest_plain_text"),
        F.col("control_chars.plain_text.examples")[0]["id"].alias("first_dirty_id"),
        F.col("top_values.type")[0]["value"].alias("top_type"),
        F.col("top_values.type")[0]["row_count"].alias("top_type_rows"),
    )


def bernoulli_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sample.bernoulli_sample(docs, "doc_id", pct=10.0).select("doc_id", "lang", "n_chars")


def bernoulli_sample_capped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sample.bernoulli_sample(docs, "doc_id", pct=50.0, cap=100)


def random_rows(spark, sf_dir):
    return sample.random_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


def sample_report(spark, sf_dir):
    return profile.sample_report(table(spark, sf_dir, "documents"), sample.is_sampled(F.col("doc_id"), 10.0))


def sample_profile(spark, sf_dir):
    """The profile of a sample, its one-row parts side by side."""
    parts = run_profile(view(spark, sf_dir, "opinions"), pct=20.0)
    rates = parts["null_rates"].agg(*[
        F.max(F.when(F.col("column_name") == c, F.col("null_pct"))).alias(f"null_{c}")
        for c in ["id", "court_id", "date_filed", "type", "plain_text"]])
    dates = parts["dates"].select(F.col("min_date").cast("date").alias("min_date"),
                                  F.col("max_date").cast("date").alias("max_date"), "null_dates")
    one_row = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [parts["lengths"], parts["empty"], dates, rates])
    return one_row.agg(*[F.first(c, ignorenulls=True).alias(c) for c in one_row.columns])


def union_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sample.union_parts([docs, docs.select("lang", "doc_id")]).groupBy("lang").agg(
        F.count(F.lit(1)).alias("row_count"))


QUERIES = {f.__name__: f for f in [
    audit_counts, row_flags, audit_quantiles_exact, audit_quantiles_approx, quantiles_from_sketches, length_histogram, length_histogram_strict,
    longest_rows, control_char_examples, null_rates, empty_counts, date_range, top_courts_keep_null,
    top_courts_drop_null, top_types, audit_summary, audit_summary_flat, bernoulli_sample, bernoulli_sample_capped,
    random_rows, sample_report, sample_profile, union_parts,
]}

_NULLISH = {c: f"({c} is null or length({c}) = 0)" for c in TEXTS}
_BUCKET = """case when length(plain_text) <= 1000 then '<=1k' when length(plain_text) <= 10000 then '1k-10k'
    when length(plain_text) <= 100000 then '10k-100k' else '>100k' end"""
_NULL_BUCKET = f"case when plain_text is null then 'null' else {_BUCKET} end"
_HASH = "cast(concat('0x', substr(md5(concat('{}:', doc_id)), 1, 8)) as bigint)"
_OPINION_COLUMNS = ["id", "type", "precedential_status", "plain_text", "html_with_citations", "date_filed", "court_id"]


def _top(column: str, where: str = "") -> str:
    return with_views(f"""select {column} as value, count(*) as row_count from opinions {where} group by {column}
        order by row_count desc, value asc nulls last limit 10""", "opinions")


# Expected columns that the view lacks.
_MISSING = [c for c in EXPECTED_COLUMNS if c not in _OPINION_COLUMNS]


def _figures(part, name, rank, key, value, rest) -> str:
    return f"""select '{part}' as part, '{name}' as name, cast({rank} as int) as rank, cast({key} as varchar) as key,
        cast({value} as varchar) as value {rest}"""


def _report() -> str:
    both = f'{_NULLISH["plain_text"]} and {_NULLISH["html_with_citations"]}'
    parts = [_figures("rows", "", 0, "null", "count(*)", "from opinions"),
             _figures("missing", "all", 0, "null", f"count(*) filter (where {both})", "from opinions"),
             "select 'missing_columns', '', cast(i - 1 as int), null, c from (select unnest(["
             + ", ".join(f"'{c}'" for c in _MISSING) + "]) as c, generate_subscripts([" + ", ".join(f"'{c}'" for c in _MISSING) + "], 1) as i)"]
    for c in TEXTS:
        bucket = _NULL_BUCKET.replace("plain_text", c)
        dirty = f"regexp_matches({c}, '{CONTROL}')"
        snippet = f"regexp_extract({c}, '(.*)', 0)"
        parts += [
            _figures("missing", c, 0, "null", f"count(*) filter (where {_NULLISH[c]})", "from opinions"),
            _figures("control", c, 0, "null", f"count(*) filter (where {dirty})", "from opinions"),
            *[_figures("quantiles", c, 0, f"'{q}'", f"quantile_disc(length({c}), {p})", "from opinions")
              for q, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p99_9", 0.999))],
            _figures("buckets", c, 0, bucket, "count(*)", f"from opinions group by {bucket}"),
            f"""select * from ({_figures("longest", c, f"row_number() over (order by length({c}) desc nulls last, id) - 1", "id", f"length({c})", "from opinions")}) where rank < 5""",
            f"""select * from ({_figures("examples", c, "row_number() over (order by id) - 1", "id",
                f"case when length({snippet}) > 200 then concat(substr({snippet}, 1, 200), '…') else {snippet} end",
                f"from opinions where {dirty}")}) where rank < 5""",
        ]
    for c in ("type", "precedential_status"):
        parts.append(f"""select * from ({_figures("top", c, f"row_number() over (order by count(*) desc, {c} asc nulls last) - 1", c, "count(*)", f"from opinions group by {c}")}) where rank < 10""")
    return " union all ".join(parts)


ORACLE = {
    "audit_summary": with_views(_report(), "opinions"),
    "audit_counts": with_views(f"""
        select count(*) as row_count,
          {", ".join(f"count(*) filter (where {_NULLISH[c]}) as nullish_{c}" for c in TEXTS)},
          count(*) filter (where {_NULLISH["plain_text"]} and {_NULLISH["html_with_citations"]}) as nullish_all,
          {", ".join(f"count(*) filter (where regexp_matches({c}, '{CONTROL}')) as control_{c}" for c in TEXTS)}
        from opinions""", "opinions"),
    "row_flags": with_views(f"""
        select id, {", ".join(f"{_NULLISH[c]} as nullish_{c}" for c in TEXTS)}, {_NULL_BUCKET} as bucket,
          {_BUCKET} as strict_bucket, cast(try_strptime(date_filed, '%Y-%m-%d') as date) as filed
        from opinions""", "opinions"),
    "audit_quantiles_exact": with_views("""
        select cast(floor(quantile_cont(n, 0.5)) as bigint) as p50, cast(floor(quantile_cont(n, 0.9)) as bigint) as p90,
          cast(floor(quantile_cont(n, 0.99)) as bigint) as p99
        from (select coalesce(length(plain_text), 0) as n from opinions)""", "opinions"),
    "audit_quantiles_approx": with_views("""
        select quantile_disc(n, 0.5) as p50, quantile_disc(n, 0.9) as p90, quantile_disc(n, 0.99) as p99,
          quantile_disc(n, 0.999) as p99_9
        from (select length(plain_text) as n from opinions)""", "opinions"),
    "quantiles_from_sketches": with_views("""
        select q, (select count(plain_text) from opinions) as n, true as close
        from (values (0.5::double), (0.9::double), (0.99::double), (0.999::double)) as asked(q)""", "opinions"),
    "length_histogram": with_views(
        f"select {_NULL_BUCKET} as bucket, count(*) as row_count from opinions group by 1", "opinions"),
    "length_histogram_strict": with_views(
        f"select {_BUCKET} as bucket, count(*) as row_count from opinions group by 1", "opinions"),
    "longest_rows": with_views("""select id, length(plain_text) as length from opinions
        order by length desc nulls last, id limit 5""", "opinions"),
    "control_char_examples": with_views(f"""
        select id, case when length(line) > 200 then concat(substr(line, 1, 200), '…') else line end as snippet
        from (select id, regexp_extract(plain_text, '(.*)', 0) as line from opinions
              where regexp_matches(plain_text, '{CONTROL}'))
        order by id limit 5""", "opinions"),
    "null_rates": with_views(" union all ".join(
        f"select '{c}' as column_name, round(avg(case when {c} is null then 1 else 0 end) * 100, 2) as null_pct from opinions"
        for c in _OPINION_COLUMNS), "opinions"),
    "empty_counts": with_views("""select count(*) filter (where coalesce(length(plain_text), 0) = 0) as empty,
        count(*) as row_count from opinions""", "opinions"),
    "date_range": with_views("""
        select min(d) as min_date, max(d) as max_date, count(*) filter (where d is null) as null_dates
        from (select cast(try_strptime(date_filed, '%Y-%m-%d') as date) as d from opinions)""", "opinions"),
    "top_courts_keep_null": _top("court_id"),
    "top_courts_drop_null": _top("court_id", "where court_id is not null"),
    "top_types": _top("type"),
    "audit_summary_flat": with_views(f"""
        select count(*) as total_rows, cast(17 as bigint) as missing_columns,
          count(*) filter (where {_NULLISH["plain_text"]} and {_NULLISH["html_with_citations"]}) as missing_all,
          {", ".join(f"count(*) filter (where {_NULLISH[c]}) as missing_{c}" for c in TEXTS)},
          {", ".join(f"quantile_disc(length({c}), 0.5) as p50_{c}" for c in TEXTS)},
          {", ".join(f"quantile_disc(length({c}), 0.999) as p99_9_{c}" for c in TEXTS)},
          {", ".join(f"count(*) filter (where regexp_matches({c}, '{CONTROL}')) as control_{c}" for c in TEXTS)},
          count(*) filter (where length(plain_text) <= 1000) as short_plain_text,
          max(length(plain_text)) as longest_plain_text,
          min(id) filter (where regexp_matches(plain_text, '{CONTROL}')) as first_dirty_id,
          (select type from opinions group by type order by count(*) desc, type limit 1) as top_type,
          (select count(*) from opinions group by type order by count(*) desc, type limit 1) as top_type_rows
        from opinions""", "opinions"),
    "bernoulli_sample": f"select doc_id, lang, n_chars from documents where {_HASH.format(42)} < 429496730",
    "bernoulli_sample_capped": f"""select doc_id, lang, n_chars from documents where {_HASH.format(42)} < 2147483648
        order by {_HASH.format(42)}, doc_id limit 100""",
    "random_rows": """select doc_id, n_chars from documents
        order by md5(concat('7:', doc_id)), doc_id limit 5""",
    "sample_report": f"select count(*) as scanned, count(*) filter (where {_HASH.format(42)} < 429496730) as sampled from documents",
    "sample_profile": with_views(f"""
        select cast(floor(quantile_cont(n, 0.5)) as bigint) as p50, cast(floor(quantile_cont(n, 0.9)) as bigint) as p90,
          cast(floor(quantile_cont(n, 0.99)) as bigint) as p99, count(*) filter (where n = 0) as empty,
          count(*) as row_count, min(d) as min_date, max(d) as max_date, count(*) filter (where d is null) as null_dates,
          {", ".join(f"round(avg(case when {c} is null then 1 else 0 end) * 100, 2) as null_{c}"
                     for c in ["id", "court_id", "date_filed", "type", "plain_text"])}
        from (select *, coalesce(length(plain_text), 0) as n, cast(try_strptime(date_filed, '%Y-%m-%d') as date) as d
              from opinions where {_HASH.format(42).replace("doc_id", "id")} < 858993459)""", "opinions"),
    "union_parts": """select lang, count(*) as row_count
        from (select doc_id, lang from documents union all select doc_id, lang from documents) group by lang""",
}
