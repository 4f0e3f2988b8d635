"""Near-duplicate embeddings against comparing all pairs."""

import math

import numpy as np
import pytest

from corpuskit.llm import embedding_dedup
from corpuskit.llm.embedding_dedup import fit_quantiser, link_embeddings, spanning_forest
from corpuskit.llm.queries import op5_embedding_near_dedup, table


def by_pairs(rows, cosine=0.95):
    """(id, links, component id, kept) of every row, by comparing all pairs."""
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    label, links = list(range(n)), [0] * n
    vectors = [np.array(v, np.float64) if usable(v) else None for _, v in rows]
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is None or b is None or len(a) != len(b):
                continue
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((key, links[i], component, key == component))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 3, "clash") for i, v in rows], "vec_id bigint, embedding array<float>, n int, unit string").repartition(3)
    got = [(r.id, r.n_links, r.component_id, r.kept) for r in link_embeddings(df).collect()]
    assert sorted(got, key=repr) == by_pairs([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def clustered(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.02, 0.15, 0.6])).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rows = clustered(1, 300)
    check(spark, rows + [(1000 + i, v) for i, (_, v) in enumerate(rows[:20])] + [(2000, [3 * x for x in rows[0][1]])])


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None, 2.0, 3.0]), (5, [float("nan"), 1.0, 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0, 1.0]),
            (7, v), (7, v), (8, v), (None, v), (None, [-1.0, 5.0, 0.0, 1.0]), (None, None), (9, [1.0, 2.0]), (10, [2.0, 4.0]), (11, [1e38, 2e38, 3e38, 3.4e38]),
            (12, [1e-40, 2e-40, 3e-40, 4e-40]), (13, [-x for x in v])]
    check(spark, rows)


def test_empty_and_unusable(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert link_embeddings(spark.createDataFrame([], schema)).count() == 0
    got = link_embeddings(spark.createDataFrame([(4, None), (2, [0.0])], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(2, 0, 2, True), (4, 0, 4, True)]


def test_recall_on_the_table(spark):
    """All links of the table: a recall of 1 here (at least 0.9 is asked for)."""
    sf_dir = "/root/testdata/sf0.1"
    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    vectors = np.array([r.embedding for r in rows], np.float64)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    expected = {r.vec_id: int(n) - 1 for r, n in zip(rows, linked.sum(1))}
    got = {r.vec_id: r for r in op5_embedding_near_dedup(spark, sf_dir).collect()}
    assert {i: r.n_links for i, r in got.items()} == expected
    parts = dict(zip(expected, spanning_forest(*np.nonzero(linked))[1]))
    assert {i: r.component_id for i, r in got.items()} == {i: rows[p].vec_id for i, p in parts.items()}


@pytest.mark.parametrize("fine", [1, 5])
def test_tables_tell_distances_up_to_the_coding_error(monkeypatch, fine):
    monkeypatch.setattr(embedding_dedup, "MOST_COARSE", 9)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(800, 12)) + 3 * rng.normal(size=(10, 12))[rng.integers(10, size=800)]
    v /= np.linalg.norm(v, axis=1)[:, None]
    q = fit_quantiser(v[:200], 9 * fine, subspaces=4, codes=16)
    assert q.lists == 9 * fine
    lists = q.nearest_lists(v, 3)
    apart = ((v[:, None, :] - q.centres(np.arange(q.lists))[None]) ** 2).sum(2)
    if fine == 1:
        assert (lists == np.argsort(apart, axis=1)[:, :3]).all()
    assert (np.diff(np.take_along_axis(apart, lists, 1), axis=1) >= -1e-12).all()
    pruned = 0
    for no in range(q.lists):
        members = np.nonzero((lists == no).any(axis=1))[0]
        if len(members):
            codes, errors = q.encode(v[members], np.full(len(members), no))
            true = np.sqrt(((v[::7, None] - v[members][None]) ** 2).sum(2))
            told = q.distances(v[::7], no, codes)
            assert (np.abs(told - true) <= errors + 1e-9).all()
            pruned += int((told > 0.4 + errors).sum())
    assert pruned > 10_000


def test_sufficient_probes_find_points_at_the_border():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    q = fit_quantiser(v[:1000], 150)
    assert 1 < q.probes < 40
    aside = rng.normal(size=v.shape)
    aside -= (aside * v).sum(1)[:, None] * v
    near = 0.95 * v + math.sqrt(1 - 0.95**2) * aside / np.linalg.norm(aside, axis=1)[:, None]
    a, b = q.nearest_lists(v, q.probes), q.nearest_lists(near, q.probes)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > 0.99


def test_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SAMPLE_VECTORS", 40)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=1 + i % 60).tolist()) for i in range(240)]
    rows += [(1000 + i, [x * 2 + rng.normal() * 1e-3 for x in v]) for i, v in rows[:120]]
    check(spark, rows)


def test_forest():
    nodes, roots = spanning_forest(np.array([5, 9, 8, 3, 20]), np.array([9, 8, 3, 4, 21]))
    assert dict(zip(nodes.tolist(), roots.tolist())) == {3: 3, 4: 3, 5: 3, 8: 3, 9: 3, 20: 20, 21: 20}
    chain = np.arange(1000)
    assert set(spanning_forest(chain, chain + 1)[1].tolist()) == {0}
