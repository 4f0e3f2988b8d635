"""From listing pages to the document backlog."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalogue.views import view, with_views
from corpuskit.functions.rulings import doc_path, doc_url, parse_payload, payload_totals
from corpuskit.operators import rulings
from corpuskit.operators.ordered import paged_listing as paged
from corpuskit.plans.backlog import run_backlog
from corpuskit.session import scratch_path
from corpuskit.sources.payloads import bad_items, explode_items, read_search_payloads

BASE_URL = "https://rulings.example.org/getdoc"
PAGE_SIZE = 100


def payloads(spark, sf_dir):
    """One JSON page per ``page_no``, the items under one of three keys."""
    items = view(spark, sf_dir, "ruling_items")
    fields = [c for c in items.columns if c != "page_no"]
    pages = items.groupBy("page_no").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("items"), F.count(F.lit(1)).alias("hits"))
    kind = F.col("page_no") % 3
    listed = F.col("items")
    return pages.select("page_no", F.when(
        kind == 0, F.to_json(F.struct(F.lit(0).alias("totalPages"), F.col("hits").alias("totalResults"), listed.alias("rulings")))
    ).when(
        kind == 1, F.to_json(F.struct(F.array(F.lit(1)).alias("facets"), listed.alias("results"), F.lit(7).alias("total_pages")))
    ).otherwise(
        F.to_json(F.struct(F.array(F.lit(1)).alias("facets"), listed.alias("hits"), F.col("hits").alias("totalHits")))
    ).alias("payload"))


def landed_payloads(spark, sf_dir):
    """The pages as files, one per page, the way they land."""
    path = scratch_path(spark, "payloads")
    pages = payloads(spark, sf_dir).select("payload").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    pages.write.option("maxRecordsPerFile", 1).text(path)
    return path


def payload_items(spark, sf_dir):
    return explode_items(payloads(spark, sf_dir)).select(
        "page_no", "idx", F.col("item")["item_id"].cast("bigint").alias("item_id"), F.col("item")["title"].alias("title"))


def odd_payload_items(spark, sf_dir):
    """Good items and the rest, over pages that are cut off, have no list, or hold items that are no objects."""
    base = view(spark, sf_dir, "ruling_items").select("page_no", "item_id")
    one = F.to_json(F.struct("item_id"))
    page = (F.when(F.col("item_id") % 5 == 0, F.concat(F.lit('{"rulings":['), one, F.lit(",7]}")))
            .when(F.col("item_id") % 5 == 1, F.concat(F.lit('{"rulings":['), one))
            .when(F.col("item_id") % 5 == 2, F.concat(F.lit('{"total":'), F.col("item_id"), F.lit("}")))
            .otherwise(F.concat(F.lit('{"note":"[{}]","hits":['), one, F.lit("]}"))))
    pages = base.select("item_id", page.alias("payload"))
    good = explode_items(pages).select("item_id", "idx", F.lit(False).alias("bad"))
    return good.unionByName(bad_items(pages).select("item_id", "idx", F.lit(True).alias("bad")))


def payload_page_totals(spark, sf_dir):
    return payloads(spark, sf_dir).select(
        "page_no", payload_totals(parse_payload(F.col("payload")), PAGE_SIZE).alias("t")).select("page_no", "t.*")


def doc_keys(spark, sf_dir):
    return rulings.with_doc_key(explode_items(payloads(spark, sf_dir))).select(
        F.col("item")["item_id"].cast("bigint").alias("item_id"), "number", "year")


def landed_doc_keys(spark, sf_dir):
    """`doc_keys` from page files."""
    items = explode_items(read_search_payloads(spark, landed_payloads(spark, sf_dir)))
    return rulings.with_doc_key(items).select(
        F.col("item")["item_id"].cast("bigint").alias("item_id"), "number", "year")


def doc_locations(spark, sf_dir):
    key = [F.col("collection"), F.col("year"), F.col("number")]
    return rulings.usable(view(spark, sf_dir, "ruling_keys")).select(
        "item_id", doc_url(BASE_URL, *key).alias("url"), doc_path(*key).alias("path"),
        doc_path(*key, suffix="json").alias("metadata_path"))


def paged_listing(spark, sf_dir):
    keys = view(spark, sf_dir, "ruling_keys").select("collection", "year", "item_id")
    return paged(keys, ["collection"], [F.desc_nulls_last("year"), F.asc("item_id")], PAGE_SIZE)


def paged_listing_limited(spark, sf_dir):
    keys = view(spark, sf_dir, "ruling_keys").select("collection", "year", "item_id")
    return paged(keys, ["collection"], [F.desc_nulls_last("year"), F.asc("item_id")], PAGE_SIZE, max_pages=2)


def pending_documents(spark, sf_dir):
    return rulings.pending_documents(
        view(spark, sf_dir, "ruling_keys"), view(spark, sf_dir, "manifest"), ["page_no", "item_id"])


def backlog(spark, sf_dir):
    pending = run_backlog(
        spark, landed_payloads(spark, sf_dir), view(spark, sf_dir, "manifest"), F.col("item")["collection"], BASE_URL)
    return pending.select("collection", "year", "number", "url", "path").withColumn("year", F.col("year").cast("int"))


def metadata_coverage(spark, sf_dir):
    stored = view(spark, sf_dir, "manifest").where("bytes > 0")
    return rulings.metadata_coverage(view(spark, sf_dir, "ruling_keys"), stored)


def harvest_progress(spark, sf_dir):
    return rulings.harvest_progress(view(spark, sf_dir, "attempts"))


QUERIES = {f.__name__: f for f in [
    payload_items, odd_payload_items, payload_page_totals, doc_keys, landed_doc_keys, doc_locations, paged_listing,
    paged_listing_limited, pending_documents, backlog, metadata_coverage, harvest_progress,
]}

_KEYS = with_views("select item_id, number, year from ruling_keys", "ruling_keys")
_PAGED = """select collection, year, item_id, cast(floor((rn - 1) / 100) as bigint) + 1 as page, (rn - 1) % 100 as idx
    from (select *, row_number() over (partition by collection order by year desc nulls last, item_id) as rn
          from ruling_keys)"""
_LOCATED = f"""concat('{BASE_URL}/', lower(collection), '/', year, '/', number, '.pdf') as url,
    concat(collection, '/', year, '/', number, '.pdf') as path"""
_PENDING = """from ruling_keys k where number is not null and year is not null and not exists (
    select 1 from manifest m where m.bytes > 0 and m.collection = k.collection and m.year = k.year and m.number = k.number)"""

ORACLE = {
    "payload_items": with_views("""
        select page_no, cast(row_number() over (partition by page_no order by item_id) - 1 as int) as idx, item_id, title
        from ruling_items""", "ruling_items"),
    "odd_payload_items": with_views("""
        select item_id, cast(0 as int) as idx, false as bad from ruling_items where item_id % 5 in (0, 3, 4)
        union all select item_id, cast(1 as int), true from ruling_items where item_id % 5 = 0
        union all select item_id, null, true from ruling_items where item_id % 5 in (1, 2)""", "ruling_items"),
    "payload_page_totals": with_views("""
        select page_no, case when page_no % 3 = 1 then 7 else cast(ceil(n / 100.0) as bigint) end as total_pages,
          case when page_no % 3 = 1 then null else n end as total_results
        from (select page_no, count(*) as n from ruling_items group by page_no)""", "ruling_items"),
    "doc_keys": _KEYS,
    "landed_doc_keys": _KEYS,
    "doc_locations": with_views(f"""
        select item_id, {_LOCATED}, concat(collection, '/', year, '/', number, '.json') as metadata_path
        from ruling_keys where number is not null and year is not null""", "ruling_keys"),
    "paged_listing": with_views(_PAGED, "ruling_keys"),
    "paged_listing_limited": with_views(f"select * from ({_PAGED}) where page <= 2", "ruling_keys"),
    "pending_documents": with_views(
        f"select item_id, page_no, collection, number, year {_PENDING}", "ruling_keys", "manifest"),
    "backlog": with_views(f"select collection, year, number, {_LOCATED} {_PENDING}", "ruling_keys", "manifest"),
    "metadata_coverage": with_views("""
        select collection, state, count(*) as documents from (
          select coalesce(k.collection, m.collection) as collection,
            case when k.number is not null and m.number is not null then 'both'
                 when m.number is null then 'meta_only' else 'doc_only' end as state
          from (select * from ruling_keys where number is not null and year is not null) k
          full outer join (select * from manifest where bytes > 0) m
            on m.collection = k.collection and m.year = k.year and m.number = k.number)
        group by collection, state""", "ruling_keys", "manifest"),
    "harvest_progress": with_views("""
        select collection, count(*) as attempts, count(*) filter (where status = 200) as saved,
          count(*) filter (where status is distinct from 200) as failed,
          count(distinct number) as documents, count(distinct number) filter (where status = 200) as documents_saved
        from attempts group by collection""", "attempts"),
}
