"""Removal of repeated byte strings with suffix arrays per shard.

Every string of ``length`` bytes has an anchor: of its windows of 64 bytes the one with the smallest hash,
which depends on the string alone. Strings can only be equal if their anchors are, so texts are cut
into pieces, one per anchor, and only pieces whose anchor occurs again are looked at. Equal pieces
are folded; the others of a shard get a suffix array and common prefixes.

Pieces of a very common anchor are spread over shards, which are then merged. Since a string is told by how far it reaches to
both sides of its anchor, shards first publish a few prints a piece: each of what all strings of a range of
reaches must share. Only ranges that several shards have are looked at more finely, down to single strings; those
are found by binary search in the suffix array of each shard, byte by byte.
"""

from __future__ import annotations

import bisect
from functools import partial, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import materialise, temporary_copies

LENGTH = 400
ANCHOR = 64
CHUNK = 1 << 20
SHARD_BYTES = 1 << 20
PIECES_PER_SHARD = 1024
# Reaches to the left of an anchor that are told apart, from one merging step to the next.
STEPS = (48, 8, 1)

_BASE = 0x9E3779B97F4A7C15
_POSITION_BITS = 21
_POSITIONS = np.uint64((1 << _POSITION_BITS) - 1)


# --- anchors ------------------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, CHUNK + 4096)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 4096)


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes at each position; equal bytes, equal hashes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    out = (sums[ANCHOR:] - sums[:-ANCHOR]) * _DOWN[: len(data) - ANCHOR + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, from running minima of blocks forwards and backwards."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces_of(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of the pieces of a text, in order.

    All strings of ``length`` bytes that start from first to last start have that one anchor. Long texts
    are taken in chunks, at whose borders a piece may end early.
    """
    hashes, firsts, lasts = [], [], []
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - length + 1, CHUNK):
        found = window_hashes(data[at : at + CHUNK + length - 1])
        keys = (found & ~_POSITIONS) | np.arange(len(found), dtype=np.uint64)
        anchor = (sliding_least(keys, length - ANCHOR + 1) & _POSITIONS).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(anchor))[0] + 1])
        hashes.append(found[anchor[first]].view(np.int64))
        firsts.append(first + at)
        lasts.append(np.concatenate([first[1:], [len(anchor)]]) - 1 + at)
    if not hashes:
        none = np.empty(0, np.int64)
        return none, none, none
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


# --- suffix arrays ------------------------------------------------------------------------------


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a number that sorts like them; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in order; a suffix ends with its piece, at the next of ``ends``, and an end sorts by its number.

    Larsson and Sadakane: suffixes are sorted by 8 bytes, then groups that are not settled yet by the rank of
    what follows, twice as far each time. A settled suffix is not touched again.
    """
    n = len(data)
    size = np.diff(ends, prepend=0)
    piece = np.repeat(np.arange(len(ends)), size)
    left = ends[piece] - np.arange(n)  # bytes up to the end
    # Bytes past the end count as none; suffixes that end differ by their piece.
    words = words_at(data)
    short = left < 8
    words[short] &= ~np.uint64(0) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))
    # A byte of the text may be zero too: among equal words the shorter suffix comes first, then by piece.
    order = np.argsort(words, kind="stable").astype(np.int32)
    ending = np.where(short, (8 - left).astype(np.int64) * (len(ends) + 1), 0)
    tail = np.where(short, len(ends) - piece, 0) + ending
    first = words[order]
    change = np.concatenate([[True], first[1:] != first[:-1]])
    group = np.cumsum(change) - 1
    mixed = np.isin(group, group[short[order]])
    if mixed.any():
        at = np.nonzero(mixed)[0]
        inner = np.lexsort((-tail[order[at]], group[at]))
        order[at] = order[at][inner]
        after = -tail[order]
        change[1:] |= (group[1:] == group[:-1]) & (after[1:] != after[:-1])
    starts = np.nonzero(change)[0]
    rank = np.empty(n, np.int32)
    rank[order] = starts[np.cumsum(change) - 1]
    left, piece = left.astype(np.int32), piece.astype(np.int32)
    depth = 8
    while True:
        sizes = np.diff(starts, append=n)
        loose = np.repeat(sizes > 1, sizes)
        if not loose.any():
            return order
        at = np.nonzero(loose)[0]
        own = order[at]
        # None of these ends before depth, or it would be settled; one that ends there sorts by its piece.
        goes_on = left[own] > depth
        following = np.where(goes_on, rank[np.where(goes_on, own + depth, 0)], piece[own] - len(ends)) + len(ends)
        key = (rank[own].astype(np.int64) << 32) | following  # shards are far smaller than 2^31 bytes
        inner = np.argsort(key)
        own, key = own[inner], key[inner]
        order[at] = own
        split = np.concatenate([[True], key[1:] != key[:-1]])
        change = ~loose
        change[at] = split
        starts = np.nonzero(change)[0]
        rank[own] = starts[(np.cumsum(change, dtype=np.int32) - 1)[at]]
        depth *= 2


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, least: int = 1) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, at most to the end of its piece.

    Kasai: from one position of a text to the next a common prefix loses at most one byte. All pieces
    are walked at the same time, each from its own start. Suffixes shorter than ``least`` are left at 0.
    """
    n = len(data)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n)
    words, eight = np.concatenate([words_at(data), np.zeros(64, np.uint64)]), 8 * np.arange(8)
    piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(n, np.int64)
    have = np.zeros(len(ends), np.int64)
    by_size = np.argsort(starts - ends, kind="stable")  # long pieces first
    sizes = (ends - starts - least + 1)[by_size]
    for step in range(max(0, int(sizes[0])) if len(sizes) else 0):
        lanes = by_size[: np.searchsorted(-sizes, -step, side="left")]
        here = starts[lanes] + step
        place = rank[here]
        lanes, here, place = (v[place > 0] for v in (lanes, here, place))
        there = order[place - 1]
        shared = np.maximum(have[lanes] - 1, 0)
        room = np.minimum(ends[lanes] - here, ends[piece[there]] - there)
        open_ = np.arange(len(lanes))
        while len(open_):
            a, b, k = here[open_], there[open_], shared[open_]
            fits = k < room[open_]
            open_, a, b, k = open_[fits], a[fits], b[fits], k[fits]
            # Eight words at a time: up to the first that differs, and in that up to the first byte.
            differ = words[(a + k)[:, None] + eight] ^ words[(b + k)[:, None] + eight]
            at = (differ != 0).argmax(axis=1)
            first = differ[np.arange(len(at)), at]
            equal = np.full(len(k), 64)
            some = first != 0
            equal[some] = 8 * at[some] + (63 - _top_bit(first[some])) // 8
            shared[open_] = np.minimum(k + equal, room[open_])
            open_ = open_[equal == 64]
        have[lanes] = shared
        out[place] = shared
    return out


def _top_bit(values: np.ndarray) -> np.ndarray:
    """Number of the highest bit that is set."""
    high = values >> np.uint64(32)
    top = np.where(high > 0, high, values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.frexp(top)[1] - 1 + np.where(high > 0, 32, 0)


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of several different pieces, the starts (flags) of strings that another place has, too."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    order = suffix_array(data, ends)
    shared = common_prefixes(data, ends, order, length) >= length
    # A suffix repeats if it shares enough with the one before it or the one after it.
    again = shared.copy()
    again[:-1] |= shared[1:]
    flags = np.zeros(len(data), bool)
    flags[order[again]] = True
    return [flags[end - len(p) : end - length + 1] for p, end in zip(pieces, ends)]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edges == 1)[0].tolist(), (np.nonzero(edges == -1)[0] - 1).tolist()))


# --- stages -------------------------------------------------------------------------------------

RUNS = "array<struct<first: bigint, last: bigint>>"
# A text is named by two hashes (t, u), 96 bits; a piece by a 128-bit hash in two halves (p, q).
CUT = "t bigint, u int, h array<bigint>, p array<bigint>, q array<bigint>, first array<bigint>, last array<bigint>"
PIECES = "h bigint, salt bigint, p bigint, q bigint, whole boolean, piece binary"


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64()))


def _halves(digests: list[bytes]) -> np.ndarray:
    """128-bit hashes as two columns of longs."""
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _cut(batches, length: int):
    seen = set()
    for batch in batches:
        names, out = ([], []), ([], [], [], [], [])
        for name, text in zip(zip(*(batch.column(i).to_pylist() for i in (0, 1))), batch.column(2)):
            if name in seen:
                continue
            seen.add(name)
            if len(seen) > 1_000_000:
                seen.clear()
            raw = text.as_py()
            h, first, last = pieces_of(raw, length)
            prints = _halves([xxhash.xxh3_128_digest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist())])
            for column, value in zip(names, name):
                column.append(value)
            for column, values in zip(out, (h, prints[:, 0], prints[:, 1], first, last)):
                column.append(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[0], pa.int64()), pa.array(names[1], pa.int32()), *map(_lists, out)], names=["t", "u", "h", "p", "q", "first", "last"])


def occurrences(texts: DataFrame, length: int) -> DataFrame:
    """A row per piece of every text: anchor ``h``, name ``p, q`` of its bytes, text ``t, u``, ``first`` and ``last`` start."""
    cut = materialise(texts.select("t", "u", "text").where(F.length("text") >= length).mapInArrow(partial(_cut, length=length), CUT), "cut")
    each = cut.select("t", "u", F.explode(F.arrays_zip("h", "p", "q", "first", "last")).alias("o"))
    return each.select("o.h", "o.p", "o.q", "t", "u", "o.first", "o.last")


def _fetch(batches, length: int):
    """Bytes of the pieces that are asked for; a text that comes again in a task is left out."""
    seen = set()
    for batch in batches:
        rows = {k: [] for k in ("h", "salt", "p", "q", "whole", "piece")}
        for name, text, wanted in zip(zip(*(batch.column(i).to_pylist() for i in (0, 1))), batch.column(2), batch.column(3)):
            if name in seen:
                continue
            seen.add(name)
            raw = text.as_py()
            for w in wanted.as_py():
                for k in ("h", "salt", "p", "q", "whole"):
                    rows[k].append(w[k])
                rows["piece"].append(raw[w["first"] : w["last"] + length])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(rows[k], pa.int64()) for k in ("h", "salt", "p", "q")), pa.array(rows["whole"], pa.bool_()), pa.array(rows["piece"], pa.binary())],
            names=list(rows))


def _shards(batches):
    """Lists of rows (h, salt, p, q, whole, piece) of about ``SHARD_BYTES``; no (h, salt) is in two of them."""
    held, size, last = {}, 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= SHARD_BYTES and row[:2] != last:
                yield list(held.values())
                held, size = {}, 0
            last = row[:2]
            if row[:4] not in held:  # a text of several tasks may send its pieces more than once
                held[row[:4]] = row
                size += len(row[5])
    if held:
        yield list(held.values())


def _runs(names: list[tuple[int, int, int]], flags: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (h, p, q, first, last) of the runs of each piece's flags."""
    rows = [(*name, first, last) for name, f in zip(names, flags) for first, last in runs_of(f)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["h", "p", "q", "first", "last"])


RUN = "h bigint, p bigint, q bigint, first bigint, last bigint"


def _compare(batches, length: int):
    """Runs of repeated starts within each piece that is not repeated as a whole."""
    for shard in _shards(batches):
        flags = repeated_starts([row[5] for row in shard], length)
        found = [((row[0], row[2], row[3]), f) for row, f in zip(shard, flags) if not row[4] and f.any()]
        yield _runs([name for name, _ in found], [f for _, f in found])


# --- merging shards -----------------------------------------------------------------------------


def anchor_place(piece: bytes, length: int) -> int:
    """Where the anchor of all strings of a piece stands in it."""
    low, high = len(piece) - length, length - ANCHOR  # within the last string and the first one
    keys = (window_hashes(np.frombuffer(piece, np.uint8)) & ~_POSITIONS) | np.arange(len(piece) - ANCHOR + 1, dtype=np.uint64)
    return low + int(keys[low : high + 1].argmin())


def shared_contexts(piece: bytes, length: int, width: int) -> dict[int, bytes]:
    """By range of ``width`` reaches to the left of the anchor: the bytes that all strings of the range hold."""
    at = anchor_place(piece, length)
    least = at - (len(piece) - length)
    out = {}
    for k in range(least // width, at // width + 1):
        left, right = k * width, max(0, length - ANCHOR - (k + 1) * width + 1)
        out[k] = piece[at - left : at + ANCHOR + right]
    return out


def _print(k: int, context: bytes) -> bytes:
    return xxhash.xxh3_128_digest(context, seed=k)


def _publish(shard: pa.Table, shared: pa.Table | None, length: int, step: int) -> pa.Table:
    """Rows (h, salt, print, string): each different context of a shard once, in the ranges that ``shared`` leaves open.

    ``string`` is the context itself in the last step, where it is a single string, and null before.
    """
    width, last = STEPS[step], step == len(STEPS) - 1
    known = set(shared.column("print").to_pylist()) if step else None
    found = {}
    for piece in set(shard.column("piece").to_pylist()) if not step or known else ():
        if step:
            before = STEPS[step - 1]
            open_ = {k for k, context in shared_contexts(piece, length, before).items() if _print(k, context) in known}
        for k, context in shared_contexts(piece, length, width).items() if not step or open_ else ():
            if not step or k * width // before in open_:
                found[_print(k, context)] = context if last else None
    h, salt = (shard.column(c)[0].as_py() if shard.num_rows else 0 for c in ("h", "salt"))
    return pa.table({
        "h": pa.array([h] * len(found), pa.int64()), "salt": pa.array([salt] * len(found), pa.int64()),
        "print": pa.array(list(found), pa.binary()), "string": pa.array(list(found.values()), pa.binary())})


def _publisher(length: int, step: int):
    return lambda shard, shared: _publish(shard, shared, length, step)


def places_of(strings: list[bytes], data: bytes, ends: np.ndarray, order: np.ndarray) -> list[int]:
    """Starts of all suffixes that begin with one of ``strings``, by binary search in the suffix array."""
    piece_end = np.repeat(ends, np.diff(ends, prepend=0)).tolist()
    order, out = order.tolist(), []
    for string in strings:
        head = lambda i: data[i : min(i + len(string), piece_end[i])]  # noqa: B023, E731
        low = bisect.bisect_left(order, string, key=head)
        high = bisect.bisect_right(order, string, lo=low, key=head)
        out += order[low:high]
    return out


def _merge(shard: pa.Table, shared: pa.Table, length: int) -> pa.Table:
    """Runs of starts of a shard's strings that are among those which several shards have, in pieces that are not repeated as a whole."""
    rows = {(h, p, q): (piece, whole) for h, p, q, piece, whole in zip(*(shard.column(c).to_pylist() for c in ("h", "p", "q", "piece", "whole")))}
    flags = np.zeros(sum(len(piece) for piece, _ in rows.values()), bool)
    ends = np.cumsum([len(piece) for piece, _ in rows.values()])
    if shared.num_rows and rows:
        data = b"".join(piece for piece, _ in rows.values())
        order = suffix_array(np.frombuffer(data, np.uint8), ends)
        flags[places_of(shared.column("string").to_pylist(), data, ends, order)] = True
    own = [(name, flags[end - len(piece) : end - length + 1]) for (name, (piece, whole)), end in zip(rows.items(), ends) if not whole]
    return pa.Table.from_batches([_runs([name for name, _ in own], [f for _, f in own])])


def merged_runs(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of strings that several shards of an anchor have.

    A shard has about ``per_shard`` pieces at most, which bounds what it publishes and what comes back to it. Prints are reduced by
    tasks before they are shuffled, so one that very many shards have does not gather.
    """
    shards, shared = pieces.groupBy("h", "salt"), None
    kind = "h bigint, salt bigint, print binary, string binary"
    for step in range(len(STEPS)):
        if shared is None:
            published = shards.applyInArrow(lambda shard: _publish(shard, None, length, 0), kind)
        else:
            published = shards.cogroup(shared.groupBy("h", "salt")).applyInArrow(_publisher(length, step), kind)
        published = materialise(published, "published")
        several = published.groupBy("h", "print").agg(
            F.min("salt").alias("low"), F.max("salt").alias("high"), F.min("string").alias("string")).where("low <> high")
        shared = published.drop("string").join(several.select("h", "print", "string"), ["h", "print"])
    return shards.cogroup(shared.groupBy("h", "salt")).applyInArrow(lambda shard, strings: _merge(shard, strings, length), RUN)


# --- the operator -------------------------------------------------------------------------------


def repeated_runs(texts: DataFrame, length: int, per_shard: int) -> DataFrame:
    """``t``, ``u`` and ``runs`` of starts, of the texts with a string of ``length`` bytes that occurs elsewhere in other texts or itself."""
    found = materialise(occurrences(texts, length), "occurrences")
    at = ["t", "u", "first", "last"]
    place = F.xxhash64("t", "u", "first")
    whole = reduce(or_, [F.min(c) != F.max(c) for c in at[:3]])
    prints = found.groupBy("h", "p", "q").agg(whole.alias("whole"), *[F.min_by(c, place).alias(c) for c in at])
    prints = materialise(prints, "prints")
    # An anchor needs comparing if it has several pieces of which one is not repeated as a whole.
    anchors = prints.groupBy("h").agg(F.count(F.lit(1)).alias("pieces"), F.bool_and("whole").alias("done"))
    anchors = materialise(anchors.where("pieces > 1 and not done"), "anchors")
    salts = F.ceil(F.col("pieces") / per_shard)
    asked = prints.join(anchors.select("h", salts.alias("salts")), "h").withColumn("salt", F.pmod(F.xxhash64("p"), "salts"))
    wanted = asked.groupBy("t", "u").agg(F.collect_list(F.struct("h", "salt", "p", "q", "whole", "first", "last")).alias("wanted"))
    wanted = materialise(wanted, "wanted")
    pieces = texts.select("t", "u", "text").join(wanted, ["t", "u"]).mapInArrow(partial(_fetch, length=length), PIECES)
    pieces = materialise(pieces, "pieces")
    shards = pieces.repartition("h", "salt").sortWithinPartitions("h", "salt")
    runs = shards.mapInArrow(partial(_compare, length=length), RUN)

    spread = anchors.where(F.col("pieces") > per_shard).select("h")
    spread_pieces = materialise(pieces.join(spread, "h").select("h", "salt", "p", "q", "whole", "piece"), "spread")
    runs = runs.unionByName(merged_runs(spread_pieces, length))

    relative = materialise(runs.groupBy("h", "p", "q").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    whole = found.join(prints.where("whole").select("h", "p", "q"), ["h", "p", "q"]).select(*at)
    some = found.join(relative, ["h", "p", "q"]).select("t", "u", F.col("first").alias("at"), F.explode("runs").alias("r")).select(
        "t", "u", (F.col("at") + F.col("r.first")).alias("first"), (F.col("at") + F.col("r.last")).alias("last"))
    return whole.unionByName(some).groupBy("t", "u").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def _remove(batches, length: int):
    for batch in batches:
        spans, kept = [], []
        for text, runs, copies in zip(batch.column(1), batch.column(2), batch.column(3)):
            raw, own = text.as_py(), []
            if copies.as_py() and len(raw) >= length:
                own = [(0, len(raw))]
            elif runs.is_valid:
                for first, last in sorted((r["first"], r["last"]) for r in runs.as_py()):
                    if own and first <= own[-1][1]:
                        own[-1] = (own[-1][0], max(own[-1][1], last + length))
                    else:
                        own.append((first, last + length))
            spans.append([{"start": a, "end": b} for a, b in own])
            borders = [0, *(x for span in own for x in span), len(raw)]
            kept.append(raw if not own else b"".join(raw[a:b] for a, b in zip(borders[::2], borders[1::2])))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int = PIECES_PER_SHARD
) -> DataFrame:
    """A row per row of ``df``: ``id``, ``n_bytes``, ``spans`` (removed runs of bytes, end exclusive), ``kept`` (the other bytes).

    A byte is removed if a string of ``length`` bytes over it starts anywhere else too, in the same text or
    another row; strings are judged by the input. A null text is empty; texts shorter than ``length``
    are kept, and longer ones are read whole. Null and repeated ids are rows like any other, so of repeated long rows nothing is kept. An empty
    table gives no row, and other columns do not matter. Spans may cut a character in two, which is why ``kept`` is binary.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumns({"t": F.xxhash64("text"), "u": F.hash("text")})
    with temporary_copies(df.sparkSession) as staying:
        copies = materialise(rows.groupBy("t", "u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "u", F.lit(True).alias("copies")), "copies")
        runs = repeated_runs(rows, length, per_shard)
        fates = materialise(runs.join(copies, ["t", "u"], "full"), "fates")
        staying.append(fates)
    joined = rows.join(fates, ["t", "u"], "left").select("id", "text", "runs", "copies")
    return joined.mapInArrow(partial(_remove, length=length), f"id {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
