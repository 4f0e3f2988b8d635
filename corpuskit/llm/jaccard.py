"""Exact Jaccard join of word n-gram sets.

Two sets that are similar enough share one of the rarest n-grams of either, whatever the order of
rarity. Documents are gathered by those n-grams, sorted by size and cut into bands; bands whose
sizes are compatible form tiles. Within a tile hashed bitmaps bound the overlap of each pair from
above by counting bits, and only pairs that pass are intersected as sorted arrays.

Only components are asked for. So each gathering is first tried against three of its members, and
tiles are made only of those gatherings that are not one component by then.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.components import components
from corpuskit.llm.exact_dedup import likely_in
from corpuskit.operators.ordered import running_totals
from corpuskit.session import materialise, temporary_copies

WIDTH = 4
PERCENT = 85
LEAST_BITS, MOST_BITS = 10, 20
BITS_PER_ITEM, WIDE_BITS_PER_ITEM = 4, 16
TILE_ROWS, TILE_BYTES = 512, 8 << 20
MEMO_WORDS = 100_000
MEMO_SETS = 50_000
ITEM_ROWS = 256
# Rows of two longs at most, 16 MB, that are sent to all tasks.
BROADCAST_ROWS = 1 << 20

# Cells of the frequency table that puts common n-grams last. Any order gives the same links.
CELLS = 1 << 20
BLOCK_CELLS = 1 << 12
MERGE_SHARDS = 64

SETS = "id {id}, digest bigint, n int, node bigint, lead boolean, hi bigint, lo bigint, bits binary, text binary"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


# --- from texts to sets -------------------------------------------------------------------------


class Numbers(dict):
    """Numbers words as they come, and keeps the hash of each."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[number] = xxhash.xxh64_intdigest(word)
        return number


class Shingler:
    """Sorted hashes of the distinct word n-grams of a text."""

    def __init__(self, width: int):
        self.width, self.words = width, Numbers()

    def items(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > MEMO_WORDS:
            self.words = Numbers()
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        hashes = self.words.hashes[numbers]
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            out = out * _MULTIPLIER + hashes[i : len(words) - width + 1 + i]
        out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(29)
        out.sort()
        fresh = np.ones(len(out), bool)
        np.not_equal(out[1:], out[:-1], out=fresh[1:])
        return out[fresh]


def bitmap(items: np.ndarray, per_item: int = BITS_PER_ITEM) -> bytes:
    """A bit per range of hashes: a power of two of bits, ``per_item`` as many as items or more, within bounds."""
    power = min(MOST_BITS, max(LEAST_BITS, (per_item * len(items) - 1).bit_length()))
    bits = np.zeros(1 << power, bool)
    bits[(items >> np.uint64(64 - power)).astype(np.intp)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def halved(bits: np.ndarray) -> np.ndarray:
    """Rows of bitmaps with each two neighbouring bits as one, as if made with half as many bits."""
    flags = np.unpackbits(bits.view(np.uint8), axis=-1, bitorder="little")
    return np.packbits(flags[:, ::2] | flags[:, 1::2], axis=-1, bitorder="little").view(np.uint64)


def _sets(batches, width: int):
    """Rows of documents; at the end of a task rows of ``n`` below 0 with its counts of items by cell."""
    shingler, seen, counts = Shingler(width), {}, CellCounts()
    first, rows = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        ids, digests, texts = batch.columns
        out = {k: [] for k in ("n", "node", "lead", "hi", "lo", "bits", "text")}
        for text in texts:
            raw = text.as_py()
            items = shingler.items(raw)
            key, node, lead = 0, None, False
            if len(items):
                key = xxhash.xxh3_128_intdigest(items.tobytes())
                if len(seen) > MEMO_SETS:
                    seen.clear()
                node = seen.setdefault(key, first + rows)
                lead = node == first + rows
                if lead:
                    counts.add(items)
            out["n"].append(len(items))
            out["node"].append(node)
            out["lead"].append(lead)
            out["hi"].append((key >> 64) - (1 << 63))
            out["lo"].append((key & ((1 << 64) - 1)) - (1 << 63))
            out["bits"].append(bitmap(items) if lead else None)
            out["text"].append(raw if lead else None)
            rows += 1
        kinds = {"n": pa.int32(), "lead": pa.bool_(), "bits": pa.binary(), "text": pa.binary()}
        yield pa.RecordBatch.from_arrays(
            [ids, digests, *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]], names=["id", "digest", *out])
        id_type = ids.type
    pa.default_memory_pool().release_unused()
    if rows:
        blocks = counts.blocks()
        none = lambda kind: pa.nulls(len(blocks), kind)
        yield pa.RecordBatch.from_arrays(
            [none(id_type), none(pa.int64()), pa.array(range(-1, -len(blocks) - 1, -1), pa.int32()), pa.array([first >> 33] * len(blocks), pa.int64()),
             none(pa.bool_()), none(pa.int64()), none(pa.int64()), none(pa.binary()), pa.array(blocks, pa.binary())], names=["id", "digest", *out])


def shingle_sets(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row per row of ``df``; equal sets of a task share the ``node`` of the first, its ``lead``.

    Rows of ``n`` below 0 are no documents but a task's counts of items, so that texts are split once for both. Only a lead keeps its text. Sets are worked out again from it where they are needed, for texts
    take half the room of their hashes.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    return rows.mapInArrow(partial(_sets, width=width), SETS.format(id=kind))


# --- which n-grams are common -------------------------------------------------------------------


def _cell(items: np.ndarray) -> np.ndarray:
    return (items & np.uint64(CELLS - 1)).astype(np.intp)


class CellCounts:
    """Counts of items by cell, gathered over many sets."""

    def __init__(self):
        self.counts, self.held, self.size = np.zeros(CELLS, np.int64), [], 0

    def add(self, items: np.ndarray) -> None:
        self.held.append(items)
        self.size += len(items)
        if self.size > CELLS:
            self._fold()

    def _fold(self) -> None:
        if self.held:
            self.counts += np.bincount(_cell(np.concatenate(self.held)), minlength=CELLS)
        self.held, self.size = [], 0

    def blocks(self) -> list[bytes]:
        self._fold()
        return [b.tobytes() for b in self.counts.reshape(-1, BLOCK_CELLS)]


def _add_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(raw.as_py(), np.int64) for raw in table.column("counts"))
    return pa.table({"block": table.column("block")[:1], "shard": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def frequency_table(counts: DataFrame) -> np.ndarray:
    """How often each cell of items occurs, over all sets. Its size is fixed: ``CELLS`` numbers.

    Blocks are added up by shard of tasks first, so that no group grows with the number of tasks alone.
    """
    kind = "block int, shard int, counts binary"
    blocks = counts.select(
        (-F.col("n") - 1).alias("block"), F.pmod("node", F.lit(MERGE_SHARDS)).cast("int").alias("shard"), F.col("text").alias("counts"))
    merged = blocks.groupBy("block", "shard").applyInArrow(_add_blocks, kind)
    rows = merged.groupBy("block").applyInArrow(_add_blocks, kind).collect()
    out = np.zeros((CELLS // BLOCK_CELLS, BLOCK_CELLS), np.int64)
    for row in rows:
        out[row.block] = np.frombuffer(row.counts, np.int64)
    return np.minimum(out.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


# --- gatherings ---------------------------------------------------------------------------------


def least_overlap(n, m, percent: int):
    """Smallest number of shared items for which percent is reached: I >= p (n + m - I)."""
    return -(-percent * (n + m) // (100 + percent))


def _prefixes(batches, shared, width: int, percent: int):
    shingler = Shingler(width)
    for batch in batches:
        keys, nodes, sizes = [], [], []
        for node, raw in zip(batch.column(0), batch.column(1)):
            items = shingler.items(raw.as_py())
            length = len(items) + percent * len(items) // -100 + 1  # n - ceil(p n) + 1
            order = np.lexsort((items, shared.value[_cell(items)]))[:length]
            keys.append(items[order].view(np.int64))
            nodes.append(np.full(len(order), node.as_py()))
            sizes.append(np.full(len(order), len(items), np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (keys, nodes, sizes)], names=["item", "node", "n"])


def gatherings(sets: DataFrame, counts: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (``key``, ``node``, ``n``): nodes that share a rare item, by the smallest of them.

    Gatherings with the same smallest node are one: copies that share many items meet a few times, not once per item.
    """
    shared = sets.sparkSession.sparkContext.broadcast(frequency_table(counts))
    work = partial(_prefixes, shared=shared, width=width, percent=percent)
    with temporary_copies(sets.sparkSession) as kept:
        entries = materialise(
            sets.where("lead").select("node", "text").mapInArrow(work, "item bigint, node bigint, n int"), "entries")
        # Nearly all items occur once; a count is the least that has to move to tell, and a Bloom filter keeps those in place.
        again = materialise(entries.groupBy("item").count().where("count > 1").select("item"), "items")
        common = materialise(likely_in(entries, "item", again).join(again, "item"), "common")
        least = materialise(common.groupBy("item").agg(F.min("node").alias("key")), "least")
        members = materialise(common.join(least, "item").select("key", "node", "n").distinct(), "members")
        kept.append(members)
    shared.destroy()
    return members


# --- pairs --------------------------------------------------------------------------------------


def _may_overlap(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of bitmaps (rows of 64-bit words) leave room for the overlap that is asked for."""
    need = least_overlap(n, m, percent)
    most = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64))
    return most >= need


def _words(maps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)


def bounded_pairs(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of bitmaps leave room for the overlap; pairs of equal sizes of bitmaps are taken together."""
    keep = np.zeros(len(x), bool)
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y)]).reshape(-1, 2)
    for p, q in np.unique(sizes, axis=0):
        at = np.nonzero((sizes[:, 0] == p) & (sizes[:, 1] == q))[0]
        a, b = _words([x[i] for i in at]), _words([y[i] for i in at])
        while a.shape[1] > b.shape[1]:
            a = halved(a)
        while b.shape[1] > a.shape[1]:
            b = halved(b)
        keep[at] = _may_overlap(a, b, n[at], m[at], percent)
    return keep


def _bound_pairs(batches, percent: int):
    for batch in batches:
        a, b, n, m, x, y = batch.columns
        n, m = (v.to_numpy().astype(np.int64) for v in (n, m))
        keep = bounded_pairs(x.to_pylist(), y.to_pylist(), n, m, percent)
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared items of two sorted arrays of distinct items: the shorter is looked up in the longer."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _exact_pairs(batches, percent: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            keep.append(overlap(a, b) >= least_overlap(len(a), len(b), percent))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _of_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose ``node`` is among ``nodes`` (written, each once).

    A list of nodes of checked size goes to where the rows are; a longer one meets the rows that a Bloom filter lets pass.
    """
    if nodes.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(nodes), "node", "left_semi")
    return likely_in(rows, "node", nodes).join(nodes, "node", "left_semi")


def _with_both(pairs: DataFrame, sets: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Written pairs with columns of both nodes. ``b`` is looked up first, for many pairs share their ``a``."""
    own = lambda rows, side, at: rows.select(F.col("node").alias(side), *[F.col(c).alias(names[at]) for c, names in columns.items()])
    small = pairs.count() <= BROADCAST_ROWS
    with_b = own(sets, "b", 1).join(F.broadcast(pairs) if small else pairs, "b")
    hubs = materialise(pairs.select(F.col("a").alias("node")).distinct(), "hubs")
    both = with_b.join(own(_of_nodes(sets, hubs), "a", 0), "a")
    return both.select("a", "b", *[names[at] for names in columns.values() for at in (0, 1)])


def _items(batches, width: int):
    shingler = Shingler(width)
    for whole in batches:
        # A few texts at a time, for their items take several times the room of the texts.
        for at in range(0, whole.num_rows, ITEM_ROWS):
            batch = whole.slice(at, ITEM_ROWS)
            found = [shingler.items(raw.as_py()) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in found], pa.int32()), pa.array([bitmap(i, WIDE_BITS_PER_ITEM) for i in found], pa.binary()),
                 pa.array([i.tobytes() for i in found], pa.binary())], names=["node", "n", "wide", "items"])
    pa.default_memory_pool().release_unused()


def verified(pairs: DataFrame, sets: DataFrame, width: int, percent: int, bounded: bool = False) -> DataFrame:
    """The pairs (``a``, ``b``) of nodes that are similar enough: by bitmaps, by wider ones, then by the sets themselves."""
    leads, bound = sets.where("lead"), partial(_bound_pairs, percent=percent)
    if not bounded:
        pairs = materialise(pairs, "tried")
        mapped = _with_both(pairs, leads, {"n": ("n", "m"), "bits": ("x", "y")})
        pairs = materialise(mapped.mapInArrow(bound, "a bigint, b bigint"), "bounded")
    asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    # Texts of nodes that no pair asks for stay where they are.
    items = materialise(_of_nodes(leads.select("node", "text"), asked).mapInArrow(
        partial(_items, width=width), "node bigint, n int, wide binary, items binary"), "items")
    wide = _with_both(pairs, items, {"n": ("n", "m"), "wide": ("x", "y")})
    close = materialise(wide.mapInArrow(bound, "a bigint, b bigint"), "bounded")
    return _with_both(close, items, {"items": ("s", "t")}).mapInArrow(partial(_exact_pairs, percent=percent), "a bigint, b bigint")


def _compare_tile(batches, percent: int):
    """Pairs of a tile whose parts are of different components and pass the bound."""
    for batch in batches:
        for x, y, same in zip(*batch.columns):
            (nodes, sizes, parts, low, maps), (nodes2, sizes2, parts2, low2, maps2) = (
                [np.array(v) if k != "bits" else v for k in ("node", "n", "component", "low", "bits") for v in [[m[k] for m in side.as_py()]]]
                for side in (x, y))
            small, large = np.minimum(sizes[:, None], sizes2[None, :]), np.maximum(sizes[:, None], sizes2[None, :])
            # Two members of the lower band also meet in the group below.
            i, j = np.nonzero((parts[:, None] != parts2[None, :]) & (100 * small >= percent * large) & ~(low[:, None] & low2[None, :]))
            if same.as_py():
                i, j = i[i < j], j[i < j]
            ok = tile_bound(maps, maps2, i, j, sizes[i].astype(np.int64), sizes2[j].astype(np.int64), percent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i[ok]], pa.int64()), pa.array(nodes2[j[ok]], pa.int64())], names=["a", "b"])


def tile_bound(x: list[bytes], y: list[bytes], i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """`bounded_pairs` of the rows ``i`` and ``j`` of two bands, with each bitmap unpacked and folded once."""
    width = min(map(len, [*x, *y]), default=0)

    def folded(maps: list[bytes]) -> np.ndarray:
        out = np.zeros((len(maps), width // 8), np.uint64)
        for at, raw in enumerate(maps):
            row = _words([raw])
            while row.shape[1] > width // 8:
                row = halved(row)
            out[at] = row[0]
        return out

    left, right, keep = folded(x), folded(y), np.zeros(len(i), bool)
    step = max(1, (1 << 22) // max(1, width))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        keep[part] = _may_overlap(left[i[part]], right[j[part]], n[part], m[part], percent)
    return keep


def bitmap_bytes(n: Column) -> Column:
    """Bytes of the `bitmap` of a set of ``n`` items."""
    power = F.ceil(F.log2(F.greatest(n * BITS_PER_ITEM, F.lit(1)).cast("double")))
    return F.pow(F.lit(2.0), F.least(F.lit(MOST_BITS), F.greatest(F.lit(LEAST_BITS), power)) - 3).cast("bigint")


def size_band(n: Column, percent: int) -> Column:
    """Number of the band of a size; sizes that are compatible are in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) * (1 - 1e-9)).cast("int")


def tiled_pairs(members: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs across components, from tiles of size bands of the gatherings with several components.

    A member stands in the group of its size band and in the next one, so those of neighbouring bands
    meet; a group of one component needs no tile. Members of the component of a group's smallest node make up tiles of
    their own, which are not compared with each other.
    """
    part, band = F.coalesce("component", "node"), size_band(F.col("n"), percent)
    own = members.join(parts, "node", "left").select("key", "node", "n", part.alias("component"), band.alias("own_band"))
    own = own.select("*", F.explode(F.array("own_band", F.col("own_band") + 1)).alias("size_band"))
    own = materialise(own.withColumn("low", F.col("own_band") < F.col("size_band")).drop("own_band"), "parts")
    group = ["key", "size_band"]
    open_keys = materialise(
        own.groupBy(*group).agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "node").alias("first"),
            F.bool_and("low").alias("lower")).where("lo <> hi and not lower").select(*group, "first"), "open")
    left = own.join(open_keys, group).withColumn("main", F.col("component") == F.col("first")).drop("first")
    # A band holds TILE_ROWS rows at most, and fewer of long texts, whose bitmaps are large.
    weight = F.greatest(F.lit(TILE_BYTES // TILE_ROWS), bitmap_bytes(F.col("n")))
    placed = running_totals(left, [*group, "main"], [F.col("n").asc(), F.col("node").asc()], {"_to": weight})
    placed = placed.withColumn("band", F.floor((F.col("_to") - weight) / TILE_BYTES))
    wanted = materialise(placed, "placed")
    maps = sets.where("lead").select("node", "bits")
    numbered = wanted.join(_of_nodes(maps, materialise(wanted.select("node").distinct(), "asked")), "node")
    bands = materialise(
        numbered.groupBy(*group, "main", "band").agg(
            F.min("n").alias("low"), F.max("n").alias("high"),
            F.collect_list(F.struct("node", "n", "component", "low", "bits")).alias("rows")), "bands")
    other = bands.where("not main").select(
        *group, F.col("band").alias("band2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("rows").alias("rows2"))
    tiles = bands.join(other, group).where(
        f"(main or band <= band2) and high * 100 >= low2 * {percent} and high2 * 100 >= low * {percent}")
    pairs = tiles.select("rows", "rows2", (~F.col("main") & (F.col("band") == F.col("band2"))).alias("same"))
    found = pairs.mapInArrow(partial(_compare_tile, percent=percent), "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- the operator -------------------------------------------------------------------------------


def _linked_sets(sets: DataFrame, counts: DataFrame, width: int, percent: int) -> DataFrame:
    """``node`` and ``component`` of the nodes that are linked with another one."""
    members = gatherings(sets, counts, width, percent)
    some = F.xxhash64("node")
    tries = materialise(members.groupBy("key").agg(
        F.min_by("n", "node").alias("n0"), F.max("node").alias("r1"), F.max_by("n", "node").alias("n1"),
        F.min_by("node", some).alias("r2"), F.min_by("n", some).alias("n2")), "tries")
    three = F.array(*[F.struct(F.col(r).alias("r"), F.col(m).alias("m")) for r, m in (("key", "n0"), ("r1", "n1"), ("r2", "n2"))])
    tried = members.join(tries, "key").select("node", "n", F.inline(three)).where("r <> node")
    tried = tried.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    tried = tried.select(F.least("r", "node").alias("a"), F.greatest("r", "node").alias("b")).distinct()
    # Sets that several tasks have: one row per set and task.
    equal = materialise(
        sets.where("lead").groupBy("hi", "lo").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1"), "equal")
    again = sets.where("lead").select("node", "hi", "lo").join(equal, ["hi", "lo"]).select(F.col("node").alias("a"), "b")
    first = components(verified(tried, sets, width, percent).unionByName(again))
    first = materialise(first, "components")
    rest = verified(materialise(tiled_pairs(members, first, sets, percent), "pairs"), sets, width, percent, bounded=True)
    return components(rest.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """A row per row of ``df``: ``id``, ``n_shingles``, ``component_id``, ``keep_digest``, ``digest``.

    Words are what ASCII white space separates, with A-Z lower-cased. A text's set holds its distinct
    n-grams of ``width`` words; a shorter text is one n-gram, and one without words or a null text has an
    empty set and no link. Rows link when percent of the union is shared. ``component_id`` is the
    smallest id that links lead to; null ids come last, so it is null only if no row of the component has an id.
    Repeated rows are rows like any other. ``digest`` hashes the text, and ``keep_digest`` is that of a
    row with the smallest id, which tells which row stays. Texts are read whole, however long; ties of ids are told apart by the
    digest. Other columns do not matter, and an empty table gives no row.
    """
    with temporary_copies(df.sparkSession) as kept:
        both = materialise(shingle_sets(df, id_col, text_col, width), "sets")
        sets, counts = both.where("n >= 0"), both.where("n < 0")
        parts = materialise(_linked_sets(sets, counts, width, percent), "components")
        rows = sets.select("id", "digest", F.col("n").alias("n_shingles"), "node").join(parts, "node", "left")
        rows = materialise(rows.withColumn("component", F.coalesce("component", "node")).drop("node"), "rows")
        heads = materialise(
            rows.where("component is not null").groupBy("component").agg(
                F.min("id").alias("component_id"), F.coalesce(F.min_by("digest", "id"), F.min("digest")).alias("keep_digest")), "heads")
        kept += [rows, heads]
    alone = F.col("component").isNull()
    return rows.join(heads, "component", "left").select(
        "id", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("digest")).otherwise(F.col("keep_digest")).alias("keep_digest"), "digest")


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``df`` without all but the one of smallest id of each component; columns stay as they are.

    Rows with the same id and the same text count as one document, and stay or go together.
    """
    found = jaccard_components(df, id_col, text_col, width, percent)
    gone = found.where(~(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("keep_digest"))))
    gone = materialise(gone.select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "gone")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(row, F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return rows.join(gone, same, "left_anti").select("row.*")
