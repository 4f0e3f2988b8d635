"""Inputs in the shape the operators expect, derived from the given tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its SQL
equivalent start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = {
    "opinions": ["documents", "pages"],
    "request_log": ["events"],
    "endpoints": ["customer"],
    "waitlist": ["customer"],
    "cues": ["conversations"],
    "ruling_items": ["documents"],
    "ruling_keys": ["documents"],
    "manifest": ["documents", "labels"],
    "attempts": ["documents", "events"],
}

OPINIONS = """
select d.doc_id as id, d.lang as type, d.source as precedential_status,
  case when d.doc_id % 11 = 0 then null when d.doc_id % 13 = 0 then ''
       when d.doc_id % 37 = 0 then concat(chr(7), d.text) else d.text end as plain_text,
  case when d.doc_id % 5 = 0 then null else p.html end as html_with_citations,
  case when d.doc_id % 17 = 0 then 'not a date' when d.doc_id % 19 = 0 then null
       else concat(cast(1990 + d.doc_id % 30 as varchar(4)), '-0', cast(1 + d.doc_id % 9 as varchar(1)),
                   '-1', cast(d.doc_id % 10 as varchar(1))) end as date_filed,
  case when d.doc_id % 23 = 0 then null else concat('court', cast(d.doc_id % 7 as varchar(1))) end as court_id
from documents d left join pages p on p.page_id = d.doc_id
"""

REQUEST_LOG = """
select event_id as req_id, ts, user_id as endpoint_id, cast(value as double) as latency_ms,
  case when event_type in ('view', 'click') then 200 when event_type = 'signup' then 429
       when event_type = 'purchase' then 404 when event_id % 5 = 0 then null
       when event_id % 5 = 1 then 403 else 503 end as status
from events
"""

ENDPOINTS = """
select c_custkey as line_no, case c_custkey % 7
  when 0 then concat('h', c_custkey, ':8080')
  when 1 then concat('h', c_custkey, ':8080:u', c_custkey, ':s3cret')
  when 2 then concat('u', c_custkey, ':s3cret@h', c_custkey, ':80')
  when 3 then concat('socks5://u:s3cret@h', c_custkey, ':1080')
  when 4 then '# note' when 5 then '   '
  else concat('h', c_custkey, ':1:2') end as line
from customer
"""

WAITLIST = """
select c_custkey as signup_id, case c_custkey % 6
  when 0 then concat('user', c_custkey, '@mail.example.com')
  when 1 then concat('user', c_custkey, '+tag@example.com')
  when 2 then concat('user', c_custkey, '@example.museum')
  when 3 then concat('user', c_custkey, '.example.com')
  when 4 then concat('user', c_custkey, '@example.org', chr(10))
  else '' end as email
from customer
"""

CUES = """
select conv_id as file_id, turn + 1 as cue_no, turn * 7000 as start_ms,
  turn * 7000 + 1000 + (length(text) % 11) * 1000 as end_ms,
  case when length(text) > 40 then concat(substring(text, 1, 20), chr(10), substring(text, 21)) else text end as text
from conversations
"""

RULING_ITEMS = """
select doc_id as item_id, cast(floor(doc_id / 100) as bigint) + 1 as page_no,
  case when doc_id % 2 = 0 then 'NY' else 'HQ' end as collection,
  case when doc_id % 4 = 0 then concat('N', cast(300000 + doc_id as varchar(6))) end as number,
  case when doc_id % 4 = 1 then concat('H', cast(300000 + doc_id as varchar(6))) end as rulingNumber,
  case when doc_id % 4 = 2 then concat('Tariff ruling N', cast(300000 + doc_id as varchar(6)), ' on goods') end as title,
  case when doc_id % 9 = 0 then null when doc_id % 2 = 0
       then concat('Issued ', cast(1990 + doc_id % 30 as varchar(4)), '-05-02') end as rulingDate,
  case when doc_id % 2 = 1 then concat('05/02/', cast(1990 + doc_id % 30 as varchar(4))) end as issueDate
from documents
"""

# What the key operators should find in the items above.
RULING_KEYS = """
select doc_id as item_id, cast(floor(doc_id / 100) as bigint) + 1 as page_no,
  case when doc_id % 2 = 0 then 'NY' else 'HQ' end as collection,
  case doc_id % 4 when 1 then concat('H', cast(300000 + doc_id as varchar(6)))
    when 3 then null else concat('N', cast(300000 + doc_id as varchar(6))) end as number,
  case when doc_id % 9 = 0 and doc_id % 2 = 0 then null else cast(1990 + doc_id % 30 as int) end as year
from documents
"""

# Labelled documents count as stored; those labelled 0 as empty files.
MANIFEST = f"""
select k.collection, k.year, k.number, cast(l.quality as bigint) as bytes
from ({RULING_KEYS}) k join labels l on l.doc_id = k.item_id
where k.number is not null and k.year is not null
"""

# Each request of the log is an attempt at the document its endpoint number names.
ATTEMPTS = f"""
select k.collection, k.year, k.number, r.req_id, r.ts, r.status
from ({REQUEST_LOG}) r join ({RULING_KEYS}) k on k.item_id = r.endpoint_id
where k.number is not null and k.year is not null
"""

VIEWS = {
    "opinions": OPINIONS, "request_log": REQUEST_LOG, "endpoints": ENDPOINTS, "waitlist": WAITLIST, "cues": CUES,
    "ruling_items": RULING_ITEMS, "ruling_keys": RULING_KEYS, "manifest": MANIFEST, "attempts": ATTEMPTS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for base in BASE_TABLES[name]:
        table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named views in front of it."""
    return "with " + ", ".join(f"{name} as ({VIEWS[name]})" for name in names) + "\n" + sql
