"""Compression of vectors to a few bytes by product codebooks, fitted with active entries only.

Components become integers, vectors are cut into equal parts, and each part has a codebook that Lloyd's
rounds refine over all vectors. From the second round on, a part whose entry stayed where it was is compared only with the
entries that moved, against the exact distance it has stored: what did not move was farther before
and still is. Other parts are compared with every entry. All numbers are exact integers; of
equal distances the entry of lower number wins, so the result does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpuskit.session import delete_folder, materialise, temporary_copies

# Fixed values of the contract.
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4

SLICE_ROWS = 2048
# Integers are cut into limbs of so many bits when they are summed, so that sums of any doubles stay exact.
LIMB_BITS = 48
MOST_LONG = (1 << 63) - 1

STATE = ("id {id}, label {label}, vector array<double>, codes binary, dists array<bigint>, "
         "part int, entry int, limb int, n bigint, sums array<bigint>")

Codebooks = list[list[list[int]]]


def exact_bound(width: int) -> int:
    """Integers up to this size have exact squared distances in double precision over ``width`` components."""
    return math.isqrt((1 << 53) // (4 * width)) - 1


def whole(x: float) -> int:
    """floor(1024 x) of any finite double."""
    return math.floor(x * SCALE) if abs(x) < 1 << 60 else int(x) * SCALE


class Assigner:
    """Nearest entries of the parts of vectors; ``moved`` flags the entries that changed since distances were stored."""

    def __init__(self, books: Codebooks, moved: list[list[bool]]):
        self.books, self.moved = books, [np.array(m, bool) for m in moved]
        self.width = len(books[0][0])
        bound = exact_bound(self.width)
        self.bound = bound if all(abs(c) <= bound for book in books for entry in book for c in entry) else -1
        if self.bound >= 0:
            self.entries = [np.array(book, np.float64) for book in books]
            self.squares = [(e * e).sum(1) for e in self.entries]

    def assign(self, vectors: np.ndarray, codes: np.ndarray | None, dists: np.ndarray | None):
        """Codes, distances (-1: does not fit in a long) and exact errors (Python integers) of the rows of ``vectors``."""
        scaled = np.floor(vectors * SCALE) if self.bound >= 0 else None
        if scaled is not None and np.abs(scaled).max(initial=0) <= self.bound:
            return self._fast(scaled, codes, dists)
        return self._exact([[whole(x) for x in v] for v in vectors.tolist()])

    def _fast(self, scaled, codes, dists):
        n = len(scaled)
        new_codes, new_dists = np.zeros((n, len(self.books)), np.uint8), np.zeros((n, len(self.books)), np.int64)
        for p in range(len(self.books)):
            own = scaled[:, p * self.width : (p + 1) * self.width]
            full = np.ones(n, bool)
            if codes is not None:
                full = self.moved[p][codes[:, p]] | (dists[:, p] < 0)
            rows = np.nonzero(full)[0]
            if len(rows):
                found = self._distances(own[rows], p, slice(None))
                best = found.argmin(1)  # the first of equal ones
                new_codes[rows, p], new_dists[rows, p] = best, found[np.arange(len(rows)), best]
            rows = np.nonzero(~full)[0]
            if len(rows):
                code, dist = codes[rows, p].copy(), dists[rows, p].copy()
                active = np.nonzero(self.moved[p])[0]
                if len(active):
                    found = self._distances(own[rows], p, active)
                    best = found.argmin(1)
                    least, entry = found[np.arange(len(rows)), best].astype(np.int64), active[best]
                    nearer = (least < dist) | ((least == dist) & (entry < code))
                    code[nearer], dist[nearer] = entry[nearer], least[nearer]
                new_codes[rows, p], new_dists[rows, p] = code, dist
        return new_codes, new_dists, new_dists.sum(1).tolist()

    def _distances(self, own, p: int, which):
        """Squared distances; every number on the way is an integer below 2^53, so doubles are exact."""
        return (own * own).sum(1)[:, None] - 2 * (own @ self.entries[p][which].T) + self.squares[p][which]

    def _exact(self, rows: list[list[int]]):
        """The same in Python's integers, for values beyond the reach of doubles."""
        codes, dists, errors = [], [], []
        for row in rows:
            own_codes, own_dists = [], []
            for p, book in enumerate(self.books):
                own = row[p * self.width : (p + 1) * self.width]
                dist, code = min((sum((a - b) ** 2 for a, b in zip(own, entry)), k) for k, entry in enumerate(book))
                own_codes.append(code)
                own_dists.append(dist)
            codes.append(own_codes)
            errors.append(sum(own_dists))
            dists.append([d if d <= MOST_LONG else -1 for d in own_dists])
        return np.array(codes, np.uint8), np.array(dists, np.int64), errors


def limbs(value: int) -> list[int]:
    """Signed digits of a number to the base 2^LIMB_BITS, lowest first."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB_BITS) - 1)))
        rest >>= LIMB_BITS
    return out


class Sums:
    """Sums of the vectors of each entry."""

    def __init__(self, parts: int, entries: int, width: int, bound: int):
        self.width, self.bound = width, bound
        self.sums = np.zeros((parts, entries, width), np.int64)
        self.counts = np.zeros((parts, entries), np.int64)
        self.ready: list[tuple] = []

    def add(self, vectors: np.ndarray, codes: np.ndarray) -> None:
        scaled = np.floor(vectors * SCALE)
        small = np.abs(scaled).max(initial=0) <= self.bound
        for p in range(codes.shape[1]):
            np.add.at(self.counts[p], codes[:, p], 1)
            if small:
                np.add.at(self.sums[p], codes[:, p], scaled[:, p * self.width : (p + 1) * self.width].astype(np.int64))
        if not small:
            self._add_large(vectors, codes)

    def _add_large(self, vectors: np.ndarray, codes: np.ndarray) -> None:
        found: dict[tuple, list[int]] = {}
        for vector, code in zip(vectors.tolist(), codes.tolist()):
            for i, x in enumerate(vector):
                p, at = divmod(i, self.width)
                for k, digit in enumerate(limbs(whole(x))):
                    found.setdefault((p, code[p], k), [0] * self.width)[at] += digit
        # A slice has few enough rows for its sums of digits to fit in a long.
        self.ready += [(p, e, k, 0, sums) for (p, e, k), sums in found.items()]

    def rows(self):
        some = zip(*(x.tolist() for x in np.nonzero(self.counts)))
        return [*self.ready, *[(p, e, 0, int(self.counts[p, e]), self.sums[p, e].tolist()) for p, e in some]]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dim)


def _round(batches, shared, schema: pa.Schema):
    """Vectors with their new codes; at the end of a task rows of its sums, whose ``part`` is not null."""
    sums = assigner = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if assigner is None:
            books, moved = shared.value
            assigner = Assigner(books, moved)
            sums = Sums(len(books), len(books[0]), assigner.width, exact_bound(assigner.width))
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            vectors = _vectors(part.column("vector"), assigner.width * len(assigner.books))
            codes = dists = None
            if part.column("codes").null_count == 0:
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                dists = part.column("dists").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            codes, dists, _ = assigner.assign(vectors, codes, dists)
            sums.add(vectors, codes)
            own = {n: part.column(n) for n in ("id", "label", "vector")} | {
                "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "dists": pa.array(dists.tolist(), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(
                [own[n] if n in own else pa.nulls(part.num_rows, schema.field(n).type) for n in schema.names], schema=schema)
    if sums is not None and (rows := sums.rows()):
        columns = dict(zip(("part", "entry", "limb", "n", "sums"), map(list, zip(*rows))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[n], schema.field(n).type) if n in columns else pa.nulls(len(rows), schema.field(n).type) for n in schema.names],
            schema=schema)


def _errors(batches, shared, schema: pa.Schema):
    """Codes and exact errors by the final codebooks; an error that does not fit in a long is null."""
    assigner = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if assigner is None:
            assigner = Assigner(*shared.value)
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            vectors = _vectors(part.column("vector"), assigner.width * len(assigner.books))
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            dists = part.column("dists").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            codes, _, errors = assigner.assign(vectors, codes, dists)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array([e if e <= MOST_LONG else None for e in errors], pa.int64())], schema=schema)


def _moved_books(books: Codebooks, state: DataFrame) -> tuple[Codebooks, list[list[bool]]]:
    """The codebooks of the next round, and which entries changed; unused entries stay.

    At most parts x entries x limbs rows come to the driver, however many vectors there are.
    """
    width = len(books[0][0])
    sums = state.where("part is not null").groupBy("part", "entry", "limb").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    totals: dict[tuple[int, int], list[int]] = {}
    counts: dict[tuple[int, int], int] = {}
    for row in sums.collect():
        own = totals.setdefault((row.part, row.entry), [0] * width)
        for i in range(width):
            own[i] += int(row[f"s{i}"]) << (LIMB_BITS * row.limb)
        counts[row.part, row.entry] = counts.get((row.part, row.entry), 0) + row.n
    new = [[[x // counts[p, e] for x in totals[p, e]] if (p, e) in totals else entry for e, entry in enumerate(book)]
           for p, book in enumerate(books)]
    return new, [[a != b for a, b in zip(old, now)] for old, now in zip(books, new)]


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def codebooks_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def compress_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """A row per kept row of ``df``: ``id``, ``codes`` (a byte per part), ``error``, ``label_error``, ``codebooks_sha256``.

    Dropped are vectors that are null or hold a null or non-finite component, and vectors whose length is not that of the
    first by id among those whose length is a multiple of ``parts`` (empty ones never are). The codebooks start as the first ``entries`` vectors by
    id, null ids last, equal ids by their components; with fewer vectors there are as many entries as vectors. Repeated rows are
    rows like any other and equal entries are all kept, the lower number being the one that is used. ``label_error`` sums the
    errors of the rows of a label, null labels together. Components may be any finite doubles: what does not fit in
    doubles is worked out in Python's integers, and an ``error`` or ``label_error`` beyond a long is null. An empty table gives
    no row. Other columns do not matter, whatever their names.
    """
    spark = df.sparkSession
    id_kind, label_kind = (df.schema[c].dataType.simpleString() for c in (id_col, label_col))
    raw = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    order = [F.col("id").asc_nulls_last(), F.col("vector").asc()]
    with temporary_copies(spark) as staying:
        kept = raw.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0) & finite)
        kept = materialise(kept, "vectors")
        first = kept.orderBy(*order).select(F.size("vector").alias("dim")).first()
        dim = first.dim if first else parts
        kept = kept.where(F.size("vector") == dim)
        start = [[whole(x) for x in r.vector] for r in kept.orderBy(*order).limit(entries).select("vector").collect()]
        width = dim // parts
        books = [[v[p * width : (p + 1) * width] for v in start] for p in range(parts)]
        moved = [[True] * len(start) for _ in range(parts)]
        state = kept.select("*", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<bigint>").alias("dists"))
        kind = STATE.format(id=id_kind, label=label_kind)
        schema, before = arrow_schema(kind), None
        for _ in range(rounds if start else 0):
            shared = spark.sparkContext.broadcast((books, moved))
            written = materialise(state.mapInArrow(partial(_round, shared=shared, schema=schema), kind), "round")
            books, moved = _moved_books(books, written)
            shared.destroy()
            if before is not None:
                delete_folder(spark, before)
            before = written._copy_path
            state = written.where("part is null").select("id", "label", "vector", "codes", "dists")
        last = f"id {id_kind}, label {label_kind}, codes binary, error bigint"
        if start:
            shared = spark.sparkContext.broadcast((books, moved))
            state = state.mapInArrow(partial(_errors, shared=shared, schema=arrow_schema(last)), last)
        else:
            state = spark.createDataFrame([], last)
        found = materialise(state, "codes")
        by_label = found.groupBy("label").agg(
            F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count(F.lit(1)).alias("all"), F.count("error").alias("known"))
        fits = (F.col("all") == F.col("known")) & (F.col("label_error") <= F.lit(MOST_LONG))
        labels = materialise(by_label.select(F.col("label").alias("_label"), F.when(fits, F.col("label_error")).cast("bigint").alias("label_error")), "labels")
        staying += [found, labels]
    # A row per label, whose copy's size Spark knows: a small one is broadcast, a large one lets hot labels be split.
    joined = found.join(labels, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("id", "codes", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
