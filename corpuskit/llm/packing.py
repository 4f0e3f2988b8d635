"""Packing of token sequences by bin completion.

The plan is made on the histogram of lengths, which has at most ``capacity`` rows whatever the number
of pieces. The largest length left is completed to a full sequence again and again: fillings that
waste least come first, and a filling is used as often as the counts allow, which uses a length up
or leaves less of it than one filling takes, so a plan has a few steps per length. Pieces find their place by their rank among those of equal length.
"""

from __future__ import annotations

import math
import os
import re
import struct
from bisect import bisect_right
from collections import Counter
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ordered import row_numbers
from corpuskit.session import materialise

CAPACITY = 4096
END_ID = 1
MEMO_WORDS = 1_000_000
PIECE_BYTES = 8 << 20

PIECES = "id {id}, piece int, start bigint, length bigint, ids binary"

# Search limits: nodes of the tree, fillings tried at a node, steps in search of a filling.
NODES, FILLINGS, STEPS = 20_000, 4, 4_000


# --- from texts to pieces ---------------------------------------------------------------------


# Letters that lower-casing maps one to one and that have no parts to be composed; sentence marks that words end with.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f]+")
MARKS = b".,;:!?"


def _printable() -> dict[int, str]:
    """Byte-level vocabularies write bytes that do not print as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Little-endian 32-bit ids of words, worked out when a word is first asked for.

    The vocabulary drops white space and never joins across it, nor a letter with a sentence mark. So a word of
    Latin letters goes straight to the merges, and its marks are looked up as a word of their own; all other words go
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer, self.shown = Tokenizer.from_file(path), _printable()
        self.model = self.tokenizer.model
        self.cores: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(MARKS)
        text = core.decode()
        if LATIN.fullmatch(text):
            ids = self.cores.get(core.lower()) or self._merged(core, text)
            if len(core) < len(word):
                ids += self[word[len(core) :]]
        else:
            found = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids

    def _merged(self, core: bytes, text: str) -> bytes:
        found = self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.shown))
        ids = self.cores[core.lower()] = struct.pack(f"<{len(found)}I", *[token.id for token in found])
        return ids


# Kept between the tasks of a Python worker.
_word_ids = lru_cache(maxsize=2)(WordIds)


class WordEncoder:
    """Ids of whole texts, put together from those of their words; words repeat, and each is encoded once while the memo lasts."""

    def __init__(self, path: str):
        self.known = _word_ids(path)

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of ``text``."""
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
            self.known.cores.clear()
        return b"".join(map(self.known.__getitem__, text.split()))  # bytes split at ASCII white space only


def _tokenize(batches, path: str, capacity: int, end_id: int):
    encoder, width, last = WordEncoder(path), 4 * capacity, struct.pack("<I", end_id)
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        at, piece, start, length, ids, held = [], [], [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "piece", "start", "length", "ids"])

        for row in range(batch.num_rows):
            whole = encoder.encode(texts[row].as_py()) + last
            for number, byte in enumerate(range(0, len(whole), width)):
                part = whole[byte : byte + width]
                at.append(row)
                piece.append(number)
                start.append(byte // 4)
                length.append(len(part) // 4)
                ids.append(part)
                held += len(part)
            if held >= PIECE_BYTES:
                yield flush()
                at, piece, start, length, ids, held = [], [], [], [], [], 0
        if at:
            yield flush()


def tokenized_pieces(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``id``, ``piece``, ``start``, ``length``, ``ids`` (32-bit, little-endian).

    A document is its ids and then ``end_id``; a null text is an empty one. Only longer documents are cut.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    work = partial(_tokenize, path=vocabulary, capacity=capacity, end_id=end_id)
    return df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).mapInArrow(work, PIECES.format(id=kind))


# --- the plan -----------------------------------------------------------------------------------


def undominated_fillings(lengths: list[int], counts: dict[int, int], room: int, wanted: int = FILLINGS) -> list[Counter]:
    """Fillings of ``room`` from the ascending ``lengths`` on hand, least waste first.

    A filling is dominated if one of its items could be exchanged for a larger one on hand, or one
    more would fit; those are left out. The search goes from large items to small ones.
    """
    found: list[tuple[int, Counter]] = []
    steps = STEPS

    def dominated(items: dict[int, int], waste: int) -> bool:
        for item in {*items, 0}:
            at = bisect_right(lengths, item + waste) - 1
            while at >= 0 and lengths[at] > item:
                if counts[lengths[at]] > items.get(lengths[at], 0):
                    return True
                at -= 1
        return False

    def search(items: dict[int, int], rest: int, top: int) -> None:
        """Goes one level deeper per distinct length, of which a filling has less than sqrt(2 * room)."""
        nonlocal steps
        steps -= 1
        at, tried = min(top, bisect_right(lengths, rest) - 1), False
        # The first way down takes as much of each length as fits; such a filling is never dominated.
        while at >= 0 and (steps > 0 or not found):
            length = lengths[at]
            for times in range(min(counts[length], rest // length), 0, -1):
                if found and (steps <= 0 or sum(waste == 0 for waste, _ in found) >= wanted):
                    return
                tried = True
                search({**items, length: times}, rest - times * length, at - 1)
            at -= 1
        if not tried and not dominated(items, rest):
            found.append((rest, Counter(items)))

    # One or two items that fill the room exactly, before the general search.
    for big in reversed(lengths[: bisect_right(lengths, room)]):
        if len(found) >= wanted or 2 * big < room:
            break
        small = room - big
        if counts[big] and (small == 0 or counts.get(small, 0) > (small == big)):
            found.append((0, Counter([big] if small == 0 else [big, small])))
    if not found:
        search({}, room, len(lengths) - 1)
    found.sort(key=lambda f: (f[0], f[1].total()))
    unique = []
    for _, filling in found:
        if filling not in unique[:wanted]:
            unique.append(filling)
    return unique[:wanted]


def completion_plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, Counter]]:
    """Steps (times, filling) that use up ``histogram`` in as few sequences as the search finds.

    Depth-first: the first way down always takes the filling of least waste and is the incumbent.
    A branch is given up once its waste leaves no room for one sequence less than the incumbent;
    the search ends when the incumbent meets the bound of total length, or after ``nodes`` nodes, but
    never before the first way down is done. A plan always holds every piece of ``histogram`` once.
    """
    total = sum(n * c for n, c in histogram.items())
    bound = -(-total // capacity)
    best, best_bins = None, math.inf
    # An open branch is its steps, chained back to front, and its waste; counts are worked out again on return.
    stack: list[tuple] = [(None, 0, 0)]
    while stack and (best is None or nodes > 0 and best_bins > bound):
        steps, bins, waste = stack.pop()
        counts = dict(histogram)
        for times, step in _forwards(steps):
            _take(counts, times, step)
        while counts and (best is None or nodes > 0):
            nodes -= 1
            if best is not None and waste > (best_bins - 1) * capacity - total:
                break
            largest = max(counts)
            rest = dict(counts)
            rest[largest] -= 1
            branches = []
            for filling in undominated_fillings(sorted(counts), rest, capacity - largest):
                step = filling + Counter([largest])
                times = min(counts[n] // k for n, k in step.items())
                lost = capacity - sum(n * k for n, k in step.items())
                # The last sequence of a packing may stay open: its room is no waste.
                closed = times - (sum(counts.values()) == times * sum(step.values()))
                branches.append(((steps, (times, step)), bins + times, waste + closed * lost))
            stack.extend(reversed(branches[1:]))
            steps, bins, waste = branches[0]
            _take(counts, *steps[1])
        if not counts and bins < best_bins:
            best, best_bins = steps, bins
    plan, placed = _forwards(best), Counter()
    for times, step in plan:
        placed.update({length: times * each for length, each in step.items()})
    if placed != Counter(histogram):
        raise RuntimeError("the packing plan does not hold every piece once")
    return plan


def _take(counts: dict[int, int], times: int, step: Counter) -> None:
    """Takes the items of a step out of ``counts``."""
    for length, each in step.items():
        counts[length] -= times * each
        if not counts[length]:
            del counts[length]


def _forwards(steps: tuple | None) -> list[tuple[int, Counter]]:
    """The steps of a chain, first one first."""
    plan = []
    while steps:
        steps, step = steps
        plan.append(step)
    return plan[::-1]


def placement(plan: list[tuple[int, Counter]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, end_rank, first_sequence, per_sequence, first_offset) of a plan; ranks from 0."""
    rows, taken, sequence = [], Counter(), 0
    for times, step in plan:
        offset = 0
        for length, each in sorted(step.items(), reverse=True):
            first = taken[length]
            taken[length] += times * each
            rows.append((length, first, taken[length], sequence, each, offset))
            offset += each * length
        sequence += times
    return rows


def pack(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep: dict[str, Column] | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Packs the documents of ``df`` into sequences of at most ``capacity`` ids.

    A row per piece: ``id``, ``piece``, ``start``, ``length``, ``sequence_id``, ``offset``, and what ``keep``
    names, expressions over the piece's ``ids``; by default ``ids`` themselves. Every row of ``df`` is a
    document of its own, also with a null or repeated id or an equal text. An empty table gives no piece.

    ``order`` names columns of ``df``, none of them null, that say which documents come first: pieces of a length are
    handed out in that order, and sequences are numbered by their first piece, which is their longest.
    """
    places = [f"_by{i}" for i in range(len(order or []))]
    key = F.struct(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(p) for c, p in zip(order or [], places)])
    keyed = df.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    pieces = tokenized_pieces(keyed, vocabulary, "key", "text", capacity, end_id).withColumnRenamed("id", "key")
    kept = keep or {"ids": F.col("ids")}
    made = materialise(pieces.select("key.*", "piece", "start", "length", *[c.alias(n) for n, c in kept.items()]), "pieces")
    numbered = made.withColumn("_no", F.monotonically_increasing_id())
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    rows = placement(completion_plan(histogram, capacity))
    plan = df.sparkSession.createDataFrame(
        rows, "at_length bigint, first_rank bigint, end_rank bigint, first_sequence bigint, each bigint, first_offset bigint")
    ranked = row_numbers(numbered, ["length"], [*[F.col(p).asc() for p in places], F.col("_no").asc()], "_rank").withColumn("_rank", F.col("_rank") - 1)
    # A few rows per length, and at most ``capacity`` lengths.
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("at_length")) & F.col("_rank").between(F.col("first_rank"), F.col("end_rank") - 1))
    nth = F.col("_rank") - F.col("first_rank")
    packed = placed.select(
        "id", "piece", "start", "length", *kept,
        (F.col("first_sequence") + F.expr("(_rank - first_rank) div each")).alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("each") * F.col("length")).alias("offset"), *places)
    if not places:
        return packed
    packed = materialise(packed, "packed")
    leading = packed.where("offset = 0").select(F.col("sequence_id").alias("_planned"), *places).withColumn("_all", F.lit(0))
    numbers = row_numbers(leading, ["_all"], [F.col(c).asc() for c in [*places, "_planned"]], "_number")
    renamed = packed.join(numbers.select("_planned", "_number"), F.col("sequence_id") == F.col("_planned"))
    return renamed.withColumn("sequence_id", F.col("_number") - 1).select("id", "piece", "start", "length", *kept, "sequence_id", "offset")
