"""Exact de-duplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one folds every row into a few cells of a bit field and keeps the cells that were hit
more than once. Pass two probes that field: a row with a cell that was hit once is unique and
passes straight through; only the others, repeats and a few false alarms, are shuffled by
their digest. The field has at most ``max_bits`` bits, which bounds its broadcast. With more rows
than it has room for, more rows are shuffled; the result never changes.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.session import materialise

# ASCII white space, as in the contract of the texts: space, tab, line ends, form feed.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
HASHES = 2
BITS_PER_ROW = 16
MAX_BITS = 1 << 29


def normalised_digest(text: Column) -> Column:
    """SHA-256 of the text with runs of white space as one space; null counts as empty."""
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")
    return F.sha2(plain.cast("binary"), 256)


def _cells(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def field_size(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    """Bits of the field: a power of two of at least one bitmap (32,768 bits), ``max_bits`` at most."""
    return max(1 << 15, min(max_bits, 1 << max(0, rows * bits_per_row - 1).bit_length()))


def repeated_cells(digests: DataFrame, digest: str, bits: int) -> DataFrame:
    """Pass one: bitmaps, by number, of the cells that more than one row falls into.

    A row whose cells coincide counts for both, which can only raise a false alarm.
    """
    cell = F.explode(F.array(*_cells(F.col(digest), bits))).alias("_cell")
    twice = digests.select(cell).groupBy("_cell").agg(F.count(F.lit(1)).alias("_hits")).where("_hits > 1")
    return twice.groupBy(F.bitmap_bucket_number("_cell").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_cell")).alias("_bitmap"))


def probe(rows: DataFrame, digest: str, field: DataFrame, bits: int, found: str) -> DataFrame:
    """Pass two: adds ``found``, false for rows that certainly occur once. Shuffles nothing."""
    hits, out = [], rows
    for i, cell in enumerate(_cells(F.col(digest), bits)):
        # At most max_bits / 8 bytes, whatever the size of the data.
        bitmaps = F.broadcast(field.select(F.col("_bucket").alias(f"_bucket{i}"), F.col("_bitmap").alias(f"_bitmap{i}")))
        position = F.bitmap_bit_position(cell)
        byte = F.conv(F.hex(F.substring(F.col(f"_bitmap{i}"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10)
        out = out.join(bitmaps, F.bitmap_bucket_number(cell) == F.col(f"_bucket{i}"), "left")
        hits.append(F.coalesce(F.getbit(byte.cast("int"), (position % 8).cast("int")) == 1, F.lit(False)))
    return out.select(*rows.columns, reduce(and_, hits).alias(found))


def key_field(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Bitmaps, by number, of the cells of all ``keys``: a Bloom filter of them."""
    cell = keys.select(F.explode(F.array(*_cells(F.col(key), bits))).alias("_cell"))
    return cell.groupBy(F.bitmap_bucket_number("_cell").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_cell")).alias("_bitmap"))


def likely_in(rows: DataFrame, key: str, keys: DataFrame, max_bits: int = 1 << 26) -> DataFrame:
    """The rows whose key is among ``keys`` (a written table of the same column), and few others.

    Nothing is shuffled but bitmaps; their broadcast has ``max_bits`` bits at most. With more keys than
    that has room for more rows pass. A join after it decides.
    """
    bits = field_size(keys.count(), max_bits=max_bits)
    field = materialise(key_field(keys, key, bits), "bloom")
    return probe(rows, key, field, bits, "_likely").where("_likely").drop("_likely")


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    bits_per_row: int = BITS_PER_ROW,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per row of ``df``: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``row``.

    Texts are equal when their digests after white-space folding are. Of equal texts the row
    with the smallest id stays; of repeated rows with that id exactly one stays; null ids come last,
    and ``keep_id`` is null if a group has no other. A null text equals the empty one. ``row`` holds the
    columns named in ``carry`` (none by default), so no column name of ``df`` can clash. An empty
    table gives an empty result.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"), normalised_digest(F.col(f"`{text_col}`")).alias("text_sha256"),
        carried.alias("row"))
    if not carry:
        rows = materialise(rows, "digests")  # narrow: texts are read and hashed once
    bits = field_size(df.count(), bits_per_row, max_bits)
    # Written once, so that probing in several plans reads the same field.
    field = materialise(repeated_cells(rows, "text_sha256", bits), "bloom")
    probed = probe(rows, "text_sha256", field, bits, "_again")

    # The number of a row is fixed by the written copy; it tells repeated rows apart.
    suspects = materialise(
        probed.where("_again").drop("_again").withColumn("_no", F.monotonically_increasing_id()), "suspects")
    groups = materialise(
        suspects.groupBy("text_sha256").agg(
            F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
            F.coalesce(F.min_by("_no", "id"), F.min("_no")).alias("_keep_no"),
        ).where("group_size > 1"), "groups")
    repeated = suspects.join(groups, "text_sha256", "left")
    once = F.col("group_size").isNull()
    checked = repeated.select(
        "id", F.when(once, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (once | (F.col("_no") == F.col("_keep_no"))).alias("kept"), "text_sha256", "row")
    passed = probed.where(~F.col("_again")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
        "text_sha256", "row")
    return passed.unionByName(checked)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without all but one of each group of equal texts; the columns stay as they are."""
    marked = exact_dedup(df, id_col, text_col, carry=df.columns)
    return marked.where("kept").select("row.*")
