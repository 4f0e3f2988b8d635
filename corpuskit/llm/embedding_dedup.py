"""Near-duplicate embeddings through product quantisation.

A vector stands in the inverted lists of its nearest coarse centroids, and what is left of it in each list is coded in
subspaces. Two vectors are compared if they share a list; distances to the codes come from tables, and only vectors that
their coding error does not rule out are compared exactly. How many lists are sufficient is measured on the sample: as many
as it takes to find every one of its vectors from a point as far away as a link may reach. A pair that shares several
lists counts in the first of them, so links are the same from both ends.

A list is cut into blocks, and a task compares two of them, so the size of a list bounds no task. Of the links of two blocks
only a spanning forest and the counts leave the task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.components import components
from corpuskit.llm.sampling import picked
from corpuskit.session import materialise, temporary_copies

LEAST_COSINE = 0.95
# The sample that centroids are fitted on has these bounds, whatever the number of vectors.
SAMPLE_VECTORS = 20_000
SAMPLE_BYTES = 64 << 20
# Coarse centroids; where more lists are needed, each is divided by centroids of what is left, which all share.
MOST_COARSE = 1024
MOST_FINE = 1024
# Vectors of the sample that the number of lists is measured with, and lists beyond what it takes.
TRIALS = 2_000
SPARE_LISTS = 1
SUBSPACES = 8
CODES = 256
ROUNDS = 8
BLOCK_ROWS = 2048
QUERY_ROWS = 256
PAIR_ROWS = 1 << 18
# Room for rounding when a bound is compared with a distance.
SLACK = 1e-6

VECTORS = "id {id}, dim int, hi bigint, lo bigint, unit binary"


def _units(batches):
    """Unit vectors in double precision; null where there is none."""
    for batch in batches:
        dims, his, los, units = [], [], [], []
        for vector in batch.column(1).to_pylist():
            unit = key = None
            if vector and None not in vector:
                values = np.array(vector, np.float64)
                # Scaled first, so that very large and very small components neither overflow nor vanish.
                most = np.abs(values).max()
                if np.isfinite(most) and most > 0:
                    values = values / most
                    unit = (values / math.sqrt(values @ values)).tobytes()
                    key = xxhash.xxh3_128_intdigest(unit)
            dims.append(len(vector) if unit else None)
            his.append((key >> 64) - (1 << 63) if unit else None)
            los.append((key & ((1 << 64) - 1)) - (1 << 63) if unit else None)
            units.append(unit)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(dims, pa.int32()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(units, pa.binary())],
            names=["id", "dim", "hi", "lo", "unit"])


# --- the index ----------------------------------------------------------------------------------


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1) - 2 * points @ centroids.T).argmin(1)


def k_means(points: np.ndarray, k: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` centroids, or as many as there are points."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centroids = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, centroids)
        sums, sizes = np.zeros_like(centroids), np.bincount(own, minlength=k)
        np.add.at(sums, own, points)
        some = sizes > 0
        centroids[some] = sums[some] / sizes[some, None]
    return centroids


@dataclass
class Quantiser:
    """Centroids of the lists, the codebook of each subspace for what is left of a vector, and the lists of a vector.

    A list is a coarse centroid and a fine one, which is added to it.
    """

    coarse: np.ndarray
    fine: np.ndarray
    books: list[np.ndarray]
    probes: int = 1

    @property
    def parts(self) -> list[slice]:
        ends = np.cumsum([book.shape[1] for book in self.books])
        return [slice(end - book.shape[1], end) for end, book in zip(ends, self.books)]

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centres(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def nearest_lists(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """Numbers of the ``most`` nearest lists of each vector, nearest first; the fine ones of the nearest coarse ones are looked at."""
        most, few = min(most, self.lists), min(len(self.coarse), most)
        coarse = (self.coarse * self.coarse).sum(1) - 2 * vectors @ self.coarse.T
        first = np.argpartition(coarse, few - 1, axis=1)[:, :few]
        # |v - c - f|^2 without |v|^2
        apart = np.take_along_axis(coarse, first, 1)[:, :, None] + (self.fine * self.fine).sum(1) - 2 * (
            (vectors @ self.fine.T)[:, None, :] - (self.coarse @ self.fine.T)[first])
        numbers = (first[:, :, None] * len(self.fine) + np.arange(len(self.fine))).reshape(len(vectors), -1)
        order = np.argsort(apart.reshape(len(vectors), -1), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(numbers, order, 1)

    def encode(self, vectors: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and coding error of vectors in the lists given for each."""
        rest = vectors - self.centres(lists)
        codes = np.stack([nearest(rest[:, part], book) for part, book in zip(self.parts, self.books)], axis=1).astype(np.uint8)
        decoded = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - decoded) ** 2).sum(1))

    def distances(self, queries: np.ndarray, list_no: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries (rows) to coded vectors of a list (columns), from one table per subspace."""
        rest = queries - self.centres(np.array([list_no]))
        total = np.zeros((len(queries), len(codes)))
        for i, (part, book) in enumerate(zip(self.parts, self.books)):
            own = rest[:, part]
            table = (own * own).sum(1)[:, None] - 2 * own @ book.T + (book * book).sum(1)
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def sufficient_probes(quantiser: Quantiser, sample: np.ndarray, cosine: float, trials: int = TRIALS) -> int:
    """Lists a vector must stand in to meet every trial: vectors of the sample, and points at the least cosine in random directions."""
    rng = np.random.default_rng(11)
    some = sample[rng.permutation(len(sample))[:trials]]
    aside = rng.normal(size=some.shape)
    aside -= (aside * some).sum(1)[:, None] * some
    size = np.linalg.norm(aside, axis=1)[:, None]
    moved = cosine * some + math.sqrt(max(0.0, 1 - cosine * cosine)) * aside / np.where(size > 0, size, 1)
    most = 16
    while True:
        met = np.full(len(some), most + 1)
        a, b = quantiser.nearest_lists(some, most), quantiser.nearest_lists(moved, most)
        for i in range(a.shape[1]):
            # The first number of lists with which both share one.
            at = (b == a[:, i : i + 1]).argmax(1)
            same = b[np.arange(len(b)), at] == a[:, i]
            met = np.where(same, np.minimum(met, np.maximum(at, i) + 1), met)
        if met.max(initial=1) <= most or most >= quantiser.lists:
            return min(int(met.max(initial=1)) + SPARE_LISTS, quantiser.lists)
        most *= 4


def fit_quantiser(sample: np.ndarray, lists: int, cosine: float = LEAST_COSINE, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
    coarse = k_means(sample, min(lists, MOST_COARSE))
    rest = sample - coarse[nearest(sample, coarse)]
    fine = np.zeros((1, sample.shape[1]))
    if lists > len(coarse):
        fine = k_means(rest, min(MOST_FINE, -(-lists // len(coarse))), seed=99)
        rest = rest - fine[nearest(rest, fine)]
    parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
    quantiser = Quantiser(coarse, fine, [k_means(rest[:, part], codes, seed=i + 1) for i, part in enumerate(parts)])
    quantiser.probes = sufficient_probes(quantiser, sample, cosine)
    return quantiser


def trivial_quantiser(dim: int) -> Quantiser:
    """One list of all vectors of a length that the sample does not have."""
    zero = np.zeros((1, dim))
    return Quantiser(zero, zero, [zero[:, part] for part in np.array_split(np.arange(dim), 1)])


# --- tasks --------------------------------------------------------------------------------------


def _index(batches, shared):
    """The lists of each vector, with its codes and error in each."""
    for batch in batches:
        nodes, units, found = [], [], []
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            at = np.nonzero(dims == dim)[0]
            quantiser = shared.value.get(int(dim)) or trivial_quantiser(int(dim))
            own = [batch.column("unit")[i].as_py() for i in at.tolist()]
            vectors = np.frombuffer(b"".join(own), np.float64).reshape(len(at), -1)
            lists = quantiser.nearest_lists(vectors, quantiser.probes)
            codes, errors = quantiser.encode(np.repeat(vectors, lists.shape[1], axis=0), lists.ravel())
            nodes += at.tolist()
            units += own
            found += [
                [{"list": no, "codes": code.tobytes(), "error": error} for no, code, error in zip(*entries)]
                for entries in zip(lists.tolist(), codes.reshape(*lists.shape, -1), errors.reshape(lists.shape).tolist())]
        kind = pa.list_(pa.struct([("list", pa.int32()), ("codes", pa.binary()), ("error", pa.float64())]))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(pa.array(nodes, pa.int64())) for c in ("node", "copies", "dim")], pa.array(units, pa.binary()), pa.array(found, kind)],
            names=["node", "copies", "dim", "unit", "entries"])


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their smallest reachable node, over the links ``a`` to ``b``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        np.minimum.at(label, before, label.copy())  # a node's former label hears of the better one
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _compare_blocks(table: pa.Table, shared, radius: float, cosine: float) -> pa.Table:
    """Counts of links of each vector of two blocks of a list (or of one with itself), and a forest of the links."""
    list_no, same = table.column("list")[0].as_py(), table.column("i")[0] == table.column("j")[0]
    quantiser = shared.value.get(dim := table.column("dim")[0].as_py()) or trivial_quantiser(dim)
    left, right = (table.filter(pa.compute.equal(table.column("block"), table.column(c)[0])) for c in "ij")
    load = lambda t: np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(t.num_rows, -1)
    lists_of = lambda t: t.column("lists").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    held, weight, from_, to = load(right), right.column("copies").to_numpy(), left.column("node").to_numpy(), right.column("node").to_numpy()
    codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, -1)
    errors, lists, asking, asked_lists, asked_weight = (
        right.column("error").to_numpy(), lists_of(right), load(left), lists_of(left), left.column("copies").to_numpy())
    counts: dict[int, int] = {}
    forest = (np.empty(0, np.int64), np.empty(0, np.int64))
    for at in range(0, len(asking), QUERY_ROWS):
        some = slice(at, at + QUERY_ROWS)
        near = quantiser.distances(asking[some], list_no, codes) <= radius + errors + SLACK
        if same:
            near &= from_[some][:, None] < to[None, :]
        held_near = np.nonzero(near.any(axis=0))[0]
        linked = near[:, held_near] & (asking[some] @ held[held_near].T >= cosine)
        i, j = np.nonzero(linked)
        i, j = i + at, held_near[j]
        # A pair counts in the first list that both stand in.
        first = np.concatenate([
            _first_shared(asked_lists[i[k : k + PAIR_ROWS]], lists[j[k : k + PAIR_ROWS]]) == list_no for k in range(0, len(i), PAIR_ROWS)] or [np.empty(0, bool)])
        i, j = i[first], j[first]
        for ids, others in ((from_[i], weight[j]), (to[j], asked_weight[i])):
            names, inverse = np.unique(ids, return_inverse=True)
            for name, n in zip(names.tolist(), np.bincount(inverse, others).astype(np.int64).tolist()):
                counts[name] = counts.get(name, 0) + n
        if len(i):
            nodes, roots = spanning_forest(np.concatenate([forest[0], from_[i]]), np.concatenate([forest[1], to[j]]))
            forest = (nodes[nodes != roots], roots[nodes != roots])
    a = [*counts, *forest[0].tolist()]
    return pa.table({
        "a": pa.array(a, pa.int64()), "b": pa.array([None] * len(counts) + forest[1].tolist(), pa.int64()),
        "n": pa.array([*counts.values(), *[0] * len(forest[0])], pa.int64())})


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number that both rows of lists hold, for each pair of rows (which share one)."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(both, a, np.iinfo(a.dtype).max).min(axis=1)


# --- the operator -------------------------------------------------------------------------------


def list_count(vectors: int) -> int:
    """Lists grow with the root of the vectors, so that lists and what stands in each grow alike."""
    return max(1, min(MOST_COARSE * MOST_FINE, 4 * math.isqrt(vectors)))


def fit_lengths(leads: DataFrame, cosine: float) -> dict[int, Quantiser]:
    """A quantiser for each length of vectors in the sample, which has bounded size whatever the table."""
    size = leads.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    if not size.n:
        return {}
    most = max(1, min(SAMPLE_VECTORS, SAMPLE_BYTES // (8 * size.dim)))
    found = leads.where(picked(["hi", "lo"], most, size.n)).orderBy("hi", "lo").limit(most).select("dim", "unit").toArrow()
    dims, units = found.column("dim").to_numpy(), found.column("unit")
    out = {}
    for dim in np.unique(dims).tolist():
        at = np.nonzero(dims == dim)[0]
        sample = np.frombuffer(b"".join(units[i].as_py() for i in at.tolist()), np.float64).reshape(len(at), dim)
        # Vectors of this length in the table, by their share of the sample.
        out[dim] = fit_quantiser(sample, list_count(max(len(at), size.n * len(at) // len(dims))), cosine)
    return out


def _links(leads: DataFrame, radius: float, cosine: float) -> DataFrame:
    """Rows (``a``, ``b``, ``n``): links of a forest, and numbers of links of ``a``."""
    shared = leads.sparkSession.sparkContext.broadcast(fit_lengths(leads, cosine))
    entry = "array<struct<list: int, codes: binary, error: double>>"
    indexed = leads.select("node", "copies", "dim", "unit").mapInArrow(
        partial(_index, shared=shared), f"node bigint, copies bigint, dim int, unit binary, entries {entry}")
    indexed = materialise(indexed, "indexed")
    rows = indexed.select("node", "copies", "dim", "unit", F.col("entries.list").alias("lists"), F.explode("entries").alias("e")).select("*", "e.*").drop("e")
    sizes = indexed.select("dim", F.explode("entries.list").alias("list")).groupBy("dim", "list").count()
    # Only lists of several blocks are told; their number is that of the rows by BLOCK_ROWS at most.
    large = materialise(sizes.where(F.col("count") > BLOCK_ROWS).select("dim", "list", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks")), "large")
    cut = rows.join(large, ["dim", "list"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, other = F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    pairs = cut.select("*", own).select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def compare(table: pa.Table) -> pa.Table:
        return _compare_blocks(table, shared, radius, cosine)

    return pairs.drop("other", "blocks").groupBy("dim", "list", "i", "j").applyInArrow(compare, "a bigint, b bigint, n bigint")


def link_embeddings(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = LEAST_COSINE
) -> DataFrame:
    """A row per row of ``df``: ``id``, ``n_links``, ``component_id`` (smallest id that links lead to), ``kept``.

    Vectors link if their cosine, in double precision, is at least ``least_cosine`` (above 0). Equal vectors are
    one class with its number of copies. The lists are fitted on a sample of ``SAMPLE_VECTORS`` at most, and every vector
    stands in as many as the trials on it ask for, so links are missed rarely if at all; none below the cosine is told. Vectors that are null, empty, zero, or hold a null or non-finite
    component link with nothing; vectors of different dimensions do not link with each other. Null ids
    come last and are kept only if their component has no id; a repeated id is a row of its own. An empty table gives no row.
    """
    kind = df.schema[id_col].dataType.simpleString()
    raw = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    with temporary_copies(df.sparkSession) as staying:
        rows = materialise(raw.mapInArrow(_units, VECTORS.format(id=kind)).withColumn("row", F.monotonically_increasing_id()), "vectors")
        valid = rows.where("unit is not null")
        classes = materialise(valid.groupBy("hi", "lo").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
        leads = materialise(
            valid.join(classes.withColumnRenamed("node", "row").drop("hi", "lo"), "row")
            .select(F.col("row").alias("node"), "copies", "dim", "hi", "lo", "unit"), "leads")

        radius = math.sqrt(max(0.0, 2 - 2 * least_cosine))
        every = materialise(_links(leads, radius, least_cosine), "links")
        parts = components(every.where("b is not null").select("a", "b"))
        counts = every.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        known = materialise(
            classes.join(parts, "node", "left").join(counts, "node", "left").select(
                "hi", "lo", F.coalesce("component", "node").alias("component"),
                (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
        joined = materialise(
            rows.select("id", "hi", "lo").join(known, ["hi", "lo"], "left").select("id", "component", F.coalesce("n_links", F.lit(0)).alias("n_links")),
            "joined")
        heads = materialise(
            joined.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id")), "heads")
        staying += [joined, heads]
    alone = F.col("component").isNull()
    component_id = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return joined.join(heads, "component", "left").select(
        "id", "n_links", component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept"))
