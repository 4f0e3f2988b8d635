"""Reader and writer queries: files are derived from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalogue.views import table, view, with_views
from corpuskit.functions.dates import gib, snapshot_date
from corpuskit.functions.text import normalise_list, slug
from corpuskit.operators.audit import audit_summary
from corpuskit.operators.sample import bernoulli_sample
from corpuskit.plans.etl import EtlOptions, run_etl
from corpuskit.session import scratch_path
from corpuskit.sinks import tables as sinks
from corpuskit.sources import files
from corpuskit.sources.bulk_csv import read_bulk_csv, split_bad_records, string_schema

NULL = "\\N"
COMPACT_BYTES = 1 << 19


def _opinions_csv(spark, sf_dir, one_file=False, **options):
    path, rows = scratch_path(spark, "csv"), view(spark, sf_dir, "opinions")
    # The table is a single row group; written by several tasks it becomes several files.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    sinks.write_csv(rows.coalesce(1) if one_file else dealt, path, null_value=NULL, **options)
    return path


def _opinions_bz2(spark, sf_dir):
    """All records in one compressed file."""
    path, rows = scratch_path(spark, "csv"), view(spark, sf_dir, "opinions")
    sinks.write_one_csv(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"), path, null_value=NULL)
    return path


def csv_roundtrip_doubled(spark, sf_dir):
    return read_bulk_csv(spark, _opinions_csv(spark, sf_dir), null_value=NULL)


def csv_roundtrip_backslash(spark, sf_dir):
    path = _opinions_csv(spark, sf_dir, dialect="backslash")
    return read_bulk_csv(spark, path, "backslash", null_value=NULL)


def csv_roundtrip_bz2(spark, sf_dir):
    return read_bulk_csv(spark, _opinions_csv(spark, sf_dir, compression="bzip2"), null_value=NULL)


def csv_split_doubled(spark, sf_dir):
    """All records in one file, many of which span lines: it is never cut, for no cut is certain to stand between records."""
    return read_bulk_csv(spark, _opinions_csv(spark, sf_dir, one_file=True), null_value=NULL)


def csv_split_backslash(spark, sf_dir):
    return read_bulk_csv(spark, _opinions_csv(spark, sf_dir, one_file=True, dialect="backslash"), "backslash", null_value=NULL)


def csv_split_bz2(spark, sf_dir):
    return read_bulk_csv(spark, _opinions_bz2(spark, sf_dir), null_value=NULL)


def bulk_etl(spark, sf_dir):
    out = scratch_path(spark, "etl")
    options = EtlOptions(null_value=NULL, target_bytes=COMPACT_BYTES)
    run_etl(spark, _opinions_csv(spark, sf_dir), out, options)
    return files.read_stage(spark, out)


def _uneven_csv(spark, sf_dir):
    """Rows without a court lose a field, rows without a readable date gain one."""
    rows = view(spark, sf_dir, "opinions").select(
        F.concat_ws(",", "id", "type", F.when(F.col("court_id").isNotNull(), F.col("precedential_status")),
                    F.when(F.col("date_filed") == "not a date", F.lit("surplus"))).alias("value"))
    path = scratch_path(spark, "uneven")
    rows.write.text(path)
    return path


def _bad_records(spark, sf_dir, policy):
    schema = string_schema(["id", "type", "precedential_status"])
    good, bad = split_bad_records(spark, _uneven_csv(spark, sf_dir), schema, policy, header=False)
    return good.select("id", F.lit(False).alias("bad")).unionByName(bad.select("id", F.lit(True).alias("bad")))


def bad_records_strict(spark, sf_dir):
    return _bad_records(spark, sf_dir, "strict")


def bad_records_padded(spark, sf_dir):
    return _bad_records(spark, sf_dir, "pandas")


def peek_rows(spark, sf_dir):
    return files.head_rows(view(spark, sf_dir, "opinions"), 10, "id").select("id", "type", "date_filed", "court_id")


def raw_head(spark, sf_dir):
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "documents").orderBy("doc_id").select("text").write.text(path)
    return files.raw_head(spark, path).select("line_no", "line")


def describe_columns(spark, sf_dir):
    return files.describe_columns(table(spark, sf_dir, "documents"))


def dataset_bytes(spark, sf_dir):
    """Of an uncompressed text copy, whose size can be told from its rows; a file per language."""
    path = scratch_path(spark, "lines")
    rows = table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("lang").write.partitionBy("lang").text(path)
    return files.dataset_bytes(spark, path)


def file_plan(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("bytes"))
    return sinks.file_plan(sizes, 100_000).withColumn("gib", gib(F.col("bytes") * 1000))


def compact_files(spark, sf_dir):
    stage, out = scratch_path(spark, "stage"), scratch_path(spark, "compact")
    sinks.write_stage(table(spark, sf_dir, "documents"), stage)
    sinks.compact(spark, stage, out, COMPACT_BYTES)
    return files.read_stage(spark, out)


def summary_json(spark, sf_dir):
    path = scratch_path(spark, "summary")
    sinks.write_summary_json(audit_summary(view(spark, sf_dir, "opinions")), path)
    report = spark.read.json(path)
    return report.select(
        "total_rows", "missing_all", F.col("missing.plain_text").alias("missing_plain_text"),
        F.col("control_chars.plain_text.count").alias("control_plain_text"))


def sample_files(spark, sf_dir):
    picked = bernoulli_sample(table(spark, sf_dir, "documents"), "doc_id", pct=10.0).select("doc_id", "lang", "text")
    back = []
    for fmt in ["parquet", "csv"]:
        path = scratch_path(spark, f"sample-{fmt}")
        sinks.write_sample(picked, path, fmt)
        read = spark.read.parquet(path) if fmt == "parquet" else read_bulk_csv(spark, path, null_value=NULL)
        back.append(read.select(F.lit(fmt).alias("fmt"), F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text"))
    return back[0].unionByName(back[1])


def document_store(spark, sf_dir):
    path = scratch_path(spark, "store")
    keys = view(spark, sf_dir, "ruling_keys").where("number is not null and year is not null")
    sinks.write_documents(keys.select(F.lower("collection").alias("collection"), "year", "number", "item_id"), path)
    return spark.read.parquet(path).select("collection", "year", "number", "item_id")


def snapshot_dates(spark, sf_dir):
    name = F.concat(F.lit("opinions-"), F.col("date_filed"), F.lit(".csv.bz2"))
    return view(spark, sf_dir, "opinions").select("id", snapshot_date(name).alias("snapshot"))


def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", slug(F.col("url")).alias("slug"))


def name_lists(spark, sf_dir):
    names = F.concat_ws(",", F.col("lang"), F.lit(" "), F.concat(F.lit(" "), F.col("source"), F.lit(" ")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(normalise_list(names), "|").alias("names"))


QUERIES = {f.__name__: f for f in [
    csv_roundtrip_doubled, csv_roundtrip_backslash, csv_roundtrip_bz2, csv_split_doubled, csv_split_backslash,
    csv_split_bz2, bulk_etl, bad_records_strict, bad_records_padded, peek_rows, raw_head, describe_columns,
    dataset_bytes, file_plan, compact_files, summary_json, sample_files, document_store, snapshot_dates, slugs,
    name_lists,
]}

_AS_TEXT = with_views("""select cast(id as varchar) as id, type, precedential_status, plain_text,
    html_with_citations, date_filed, court_id from opinions""", "opinions")
_SAMPLED = "cast(concat('0x', substr(md5(concat('42:', doc_id)), 1, 8)) as bigint) < 429496730"
_SHORT = "(case when court_id is null then 1 else 0 end - case when date_filed = 'not a date' then 1 else 0 end)"

ORACLE = {
    "dataset_bytes": "select cast(sum(strlen(coalesce(text, '')) + 1) as bigint) as bytes, count(distinct lang) as files from documents",
    **{name: _AS_TEXT for name in [
        "csv_roundtrip_doubled", "csv_roundtrip_backslash", "csv_roundtrip_bz2", "csv_split_doubled",
        "csv_split_backslash", "csv_split_bz2", "bulk_etl"]},
    # One field lost and one gained leaves the right number of fields.
    "bad_records_strict": with_views(f"""select cast(id as varchar) as id,
        coalesce({_SHORT}, 0) <> 0 as bad from opinions""", "opinions"),
    "bad_records_padded": with_views(f"""select cast(id as varchar) as id,
        coalesce({_SHORT}, 0) < 0 as bad from opinions""", "opinions"),
    "peek_rows": with_views("select id, type, date_filed, court_id from opinions order by id limit 10", "opinions"),
    "raw_head": """
        select line_no, line from (
          select row_number() over (order by doc_id, i) as line_no, line from (
            select doc_id, unnest(string_split(text, chr(10))) as line,
              generate_subscripts(string_split(text, chr(10)), 1) as i from documents))
        where line <> '' order by line_no limit 3""",
    "describe_columns": """
        select position, name, type, (select count(*) from documents) as row_count, 5 as column_count
        from (values (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'),
                     (3, 'source', 'string'), (4, 'n_chars', 'bigint')) as c(position, name, type)""",
    "file_plan": """
        select lang, bytes, greatest(1, cast(ceil(bytes / 100000.0) as bigint)) as num_files,
          printf('%.1f', bytes * 1000 / 1073741824.0) as gib
        from (select lang, cast(sum(n_chars) as bigint) as bytes from documents group by lang)""",
    "compact_files": "select doc_id, text, lang, source, n_chars from documents",
    "summary_json": with_views(r"""
        select count(*) as total_rows,
          count(*) filter (where (plain_text is null or length(plain_text) = 0)
                             and (html_with_citations is null or length(html_with_citations) = 0)) as missing_all,
          count(*) filter (where plain_text is null or length(plain_text) = 0) as missing_plain_text,
          count(*) filter (where regexp_matches(plain_text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) as control_plain_text
        from opinions""", "opinions"),
    "sample_files": f"""
        select fmt, doc_id, lang, text from documents, (values ('parquet'), ('csv')) as f(fmt) where {_SAMPLED}""",
    "document_store": with_views("""select collection, year, number, item_id from ruling_keys
        where number is not null and year is not null""", "ruling_keys"),
    "snapshot_dates": with_views("""
        select id, case when date_filed is null then null when date_filed = 'not a date' then 'opinions-not a date.csv.bz2'
          else date_filed end as snapshot from opinions""", "opinions"),
    "slugs": """select page_id, coalesce(nullif(trim(regexp_replace(url, '[^0-9A-Za-z]+', '_', 'g'), '_'), ''), 'blank') as slug
        from pages""",
    "name_lists": "select doc_id, concat(upper(lang), '|', upper(source)) as names from documents",
}
