"""Fields of JSON listing pages, whose key names differ from source to source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key names seen in listings, in order of preference, and the forms of
# numbers and years.
NUMBER_KEYS = ["number", "rulingNumber", "docNumber", "controlNumber"]
DATE_KEYS = ["rulingDate", "date", "dateIssued", "issueDate", "publicationDate"]
TITLE_KEYS = ["title", "heading"]
ITEM_KEYS = ["rulings", "results"]
PAGE_TOTAL_KEYS = ["totalPages", "total_pages"]
HIT_TOTAL_KEYS = ["totalResults", "total", "totalHits"]
NUMBER_PATTERN = r"\b([NH]\d{6})\b"
YEAR_PATTERN = r"\b(20\d{2}|19\d{2})\b"


def parse_payload(json: Column) -> Column:
    """Payload to ``struct<text, value>``: its values as texts, nested ones as compact JSON with their keys in order, and
    as variants, which tell a list from a text that looks like one. Both are null where the payload is no object."""
    return F.struct(F.from_json(json, "map<string,string>").alias("text"), F.from_json(json, "map<string,variant>").alias("value"))


def raw_items(payload: Column) -> Column:
    """Items of a parsed payload as texts; null when it has none.

    A list under a known key wins; otherwise the first value, in document order, that
    is an empty list or a list starting with an object.
    """
    text, value = payload["text"], payload["value"]

    def is_list(key: Column) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_element_at(value, key)).startswith("ARRAY"), F.lit(False))

    def holds_objects(key: Column) -> Column:
        return is_list(key) & F.try_element_at(text, key).rlike(r"^\s*\[\s*[\]{]")

    known = [F.when(is_list(F.lit(key)), F.try_element_at(text, F.lit(key))) for key in ITEM_KEYS]
    other = F.try_element_at(text, F.get(F.filter(F.map_keys(text), holds_objects), F.lit(0)))
    return F.from_json(F.coalesce(*known, other), "array<string>")


def parse_item(raw: Column) -> Column:
    """An item's text as ``map<string,string>``; null where it is no object."""
    return F.when(raw.rlike(r"^\s*\{"), F.from_json(raw, "map<string,string>"))


def payload_items(payload: Column) -> Column:
    """Items of a parsed payload as ``array<map<string,string>>``, without those that are no objects; null when it has none."""
    return F.filter(F.transform(raw_items(payload), parse_item), lambda item: item.isNotNull())


def payload_totals(payload: Column, page_size: int = 100) -> Column:
    """``struct<total_pages, total_results>``; zero counts as missing, as do bad numbers.

    Pages are worked out from the hits when the payload does not state them.
    """
    def number(key: str) -> Column:
        return F.try_element_at(payload["text"], F.lit(key)).try_cast("double").try_cast("bigint")

    def first_non_zero(keys: list[str]) -> Column:
        *preferred, last = [number(key) for key in keys]
        return F.coalesce(*[F.nullif(n, F.lit(0)) for n in preferred], last)

    stated, results = first_non_zero(PAGE_TOTAL_KEYS), first_non_zero(HIT_TOTAL_KEYS)
    derived = F.ceil(results / F.lit(page_size)) if page_size else F.lit(None).cast("bigint")
    unstated = F.coalesce(stated, F.lit(0)) == 0
    pages = F.when(unstated & results.isNotNull(), derived).otherwise(stated)
    return F.struct(pages.alias("total_pages"), results.alias("total_results"))


def _first_filled(item: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(item, F.lit(key)), F.lit("")) for key in keys])


def doc_key(item: Column) -> Column:
    """``struct<number, year>`` of a listing item; either may be null.

    The number falls back to one quoted in the title. The year comes from date fields only.
    """
    quoted = F.nullif(F.regexp_extract(_first_filled(item, TITLE_KEYS), NUMBER_PATTERN, 1), F.lit(""))
    year = F.regexp_extract(_first_filled(item, DATE_KEYS), YEAR_PATTERN, 1).try_cast("int")
    return F.struct(F.coalesce(_first_filled(item, NUMBER_KEYS), quoted).alias("number"), year.alias("year"))


def doc_url(base_url: str, collection: Column, year: Column, number: Column) -> Column:
    return F.format_string(f"{base_url}/%s/%s/%s.pdf", F.lower(collection), year, number)


def doc_path(collection: Column, year: Column, number: Column, suffix: str = "pdf") -> Column:
    return F.format_string(f"%s/%s/%s.{suffix}", F.upper(collection), year, number)
