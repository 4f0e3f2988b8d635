"""One large bzip2 CSV file, read by many tasks where that is certain to give what one task gives.

Where a record ends depends on all quotes before it. A scan cuts each piece of the file into records under the better of
the two guesses, inside quotes or not, and counts its quotes; their sums tell which guesses were right, and if one was
not the file is scanned again with what is known by then. That holds for well-quoted files only: each record found is
held against the grammar of these, and a file with a single odd one is left to the reader of whole files. Fields are
not read here but by Spark's CSV parser, record by record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from corpuskit.session import materialise, temporary_copies

_BARE = r'[^",\n\r\x00]*'
_FIELD = rf'(?:{_BARE}|"(?:[^"\r]|"")*")'
# Fields that are bare or quoted from end to end; and no blank in front, for the parser skips some such lines.
GRAMMAR = rf"^{_FIELD}(?:,{_FIELD})*$"
STARTS = r"^[^\s\x00-\x20]"
# Parts of records: the end of one begun in an earlier piece, whole ones, and the last of a piece, which may go on in the next.
# A row on the piece itself says whether it was taken to start inside quotes (`header`) and if its quotes are odd (`sound`).
END, WHOLE, LAST, PIECE = 0, 1, 2, 3
# Fields that a guess looks at.
MOST_FIELDS = 50
PARTS = "piece long, kind int, header boolean, sound boolean, record string"


def well_quoted(records: pa.Array) -> pa.Array:
    return pc.and_(pc.match_substring_regex(records, STARTS), pc.match_substring_regex(records, GRAMMAR))


def _lines(spark: SparkSession, file: str) -> DataFrame:
    lines = spark.read.schema("value string").option("lineSep", "\n").text(file)
    return lines.select(F.col("_metadata.file_block_start").alias("piece"), "value")


def _pieces(batches) -> Iterator[tuple[int, pa.Array]]:
    """Runs of lines of a piece, in order; a batch may hold lines of several."""
    for batch in batches:
        ends = pc.run_end_encode(batch.column(0)) if batch.num_rows else None
        start = 0
        for piece, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()) if ends is not None else []:
            yield piece, batch.column(1).slice(start, end - start)
            start = end


def _join(lines: pa.Array, starts: list[int]) -> pa.Array:
    """Records from lines, each from one of the ``starts`` up to the next."""
    offsets = pa.array([*starts, len(lines)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")


def _rows(piece: int, kind: int, header: bool, records: pa.Array) -> Iterator[pa.RecordBatch]:
    n = len(records)
    if n:
        sound = well_quoted(records) if kind == WHOLE else pa.array([True] * n)
        marks = pa.array([header] + [False] * (n - 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([piece] * n, pa.int64()), pa.array([kind] * n, pa.int32()), marks, sound, records],
            names=["piece", "kind", "header", "sound", "record"])


def _starts(lines: pa.Array, inside: bool) -> tuple[list[int], bool]:
    """Lines that start a record, if the first one starts ``inside`` quotes or not, and whether the last one ends inside."""
    after = (pc.cumulative_sum(pc.count_substring(lines, '"')).to_numpy() + inside) % 2 == 1
    return ([] if inside else [0]) + [int(i) + 1 for i in (~after[:-1]).nonzero()[0]], bool(after[-1])


def _guess(lines: pa.Array, fields: int) -> bool:
    """Whether lines seem to start inside quotes: more of what are records then have all their fields."""
    full = rf"^{_FIELD}(?:,{_FIELD}){{{min(fields, MOST_FIELDS) - 1},}}$"
    shares = []
    for inside in (False, True):
        starts, _ = _starts(lines, inside)
        records = _join(lines.slice(starts[0]), [i - starts[0] for i in starts]) if starts else lines[:0]
        shares.append(pc.sum(pc.match_substring_regex(records, full)).as_py() / len(records) if len(records) else 0)
    return shares[1] > shares[0]


def _cut(batches, fields: int, quoted: dict[int, bool] | None = None) -> Iterator[pa.RecordBatch]:
    """Records of the pieces a task reads; ``quoted`` tells of a piece whether it starts inside quotes, if that is known."""
    piece, begun, inside, kind, header, held = None, False, False, END, False, []

    def last() -> Iterator[pa.RecordBatch]:
        yield from _rows(piece, kind, header and kind == LAST, _join(pa.concat_arrays(held), [0]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([piece], pa.int64()), pa.array([PIECE], pa.int32()), pa.array([begun]), pa.array([begun != inside]),
             pa.nulls(1, pa.string())], names=["piece", "kind", "header", "sound", "record"])

    for at, lines in _pieces(batches):
        if at != piece:
            if held:
                yield from last()
            # Lines in front of the first start belong to a record of an earlier piece.
            begun = at > 0 and (_guess(lines, fields) if quoted is None else quoted[at])
            piece, inside, kind, header, held = at, begun, END, at == 0, []
        starts, inside = _starts(lines, inside)
        if not starts:
            held.append(lines)
            continue
        if starts[0] or held:
            before = pa.concat_arrays([*held, lines.slice(0, starts[0])])
            yield from _rows(piece, kind if kind == END else WHOLE, header and kind == LAST, _join(before, [0]))
            header = header and kind != LAST
        if len(starts) > 1:
            whole = lines.slice(starts[0], starts[-1] - starts[0])
            yield from _rows(piece, WHOLE, header, _join(whole, [i - starts[0] for i in starts[:-1]]))
            header = False
        kind, held = LAST, [lines.slice(starts[-1])]
    if held:
        yield from last()


def _check(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), well_quoted(batch.column(2)), batch.column(2)], names=batch.schema.names)


def read_well_quoted(spark: SparkSession, file: str, schema: StructType, options: dict[str, str]) -> DataFrame | None:
    """The rows below the header of a file whose quotes are doubled; null if not all of its records are well quoted."""
    with temporary_copies(spark) as kept:
        quoted, fields = None, len(schema)
        for _ in range(2):
            cut = _lines(spark, file).mapInArrow(lambda batches, known=quoted: _cut(batches, fields, known), PARTS)
            parts = materialise(cut, "csv-records")
            quoted, guessed, inside = {}, {}, False
            for row in sorted(parts.where(F.col("kind") == PIECE).select("piece", "header", "sound").collect()):
                quoted[row.piece], guessed[row.piece] = inside, row.header
                inside ^= row.sound
            if quoted == guessed:
                break
        if inside or not quoted or quoted != guessed:
            return None
        # At most two of a piece: the end of a record begun before it, and the start of one that may go on behind it.
        begun = F.last(F.when(F.col("kind") == LAST, F.col("piece")), ignorenulls=True)
        chained = parts.where(F.col("kind").isin(END, LAST)).withColumn("chain", begun.over(Window.orderBy("piece", "kind")))
        line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "kind", "record"))), lambda p: p["record"]), "\n")
        joined = chained.groupBy("chain").agg(F.max("header").alias("header"), line.alias("record"))
        stitched = joined.select("header", F.lit(True).alias("sound"), "record")
        stitched = materialise(stitched.mapInArrow(_check, stitched.schema), "csv-cut-records")
        records = parts.where(F.col("kind") == WHOLE).select("header", "sound", "record").unionByName(stitched)
        if not records.where(~F.coalesce("sound", F.lit(False))).isEmpty():
            return None
        kept += [parts, stitched]
    fields = F.from_csv("record", schema.toDDL(), options).alias("_row")
    return records.where(~F.col("header")).select(fields).select("_row.*")
