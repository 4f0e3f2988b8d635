"""Vector codes against Lloyd's rounds in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpuskit.llm import vector_codes
from corpuskit.llm.vector_codes import compress_vectors

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, error string"


def brute_force(rows, parts=4, entries=256, rounds=4):
    """Every part against every entry in every round, in Python's integers. ``rows``: (id, vector, label)."""
    kept = [(i, [math.floor(x * 1024) if abs(x) < 2**60 else int(x) * 1024 for x in v], label) for i, v, label in rows]
    start = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut([math.floor(x * 1024) if abs(x) < 2**60 else int(x) * 1024 for x in r[1]])[p] for r in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda own, p: min((far(own, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[nearest(own, p)[1] for p, own in enumerate(cut(v))] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), f in zip(kept, found) if f[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    last = [[nearest(own, p) for p, own in enumerate(cut(v))] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in last]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), bytes(k for _, k in f).hex(), e, total[label], digest) for (i, _, label), f, e in zip(kept, last, errors))


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, label, "clash", "x") for i, v, label in rows], SCHEMA).repartition(3)
    got = compress_vectors(df, **how).collect()
    return sorted((str(r.id), bytes(r.codes).hex(), r.error, r.label_error, r.codebooks_sha256) for r in got)


def vectors(n, dim, seed, grain=None):
    rng = random.Random(seed)
    draw = (lambda: rng.randrange(-grain, grain) / 1024) if grain else (lambda: rng.gauss(0, 1))
    return [(i, [draw() for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("n, dim, entries, grain", [(120, 8, 16, None), (90, 4, 256, None), (200, 8, 12, 3), (40, 12, 5, 2)])
def test_equals_brute_force(spark, n, dim, entries, grain):
    """A coarse grain makes many ties and equal entries."""
    rows = vectors(n, dim, n, grain)
    assert found(spark, rows, entries=entries) == brute_force(rows, entries=entries)


def test_active_entries_equal_full_scans():
    rng = np.random.default_rng(3)
    points = rng.integers(-4, 4, (400, 8)) / 1024
    books = [[[int(x) for x in rng.integers(-4, 4, 4)] for _ in range(20)] for _ in range(2)]
    codes, dists, _ = vector_codes.Assigner(books, [[True] * 20] * 2).assign(points, None, None)
    for _ in range(6):
        moved = [[bool(x) for x in rng.random(20) < 0.3] for _ in range(2)]
        books = [[[int(x) for x in rng.integers(-4, 4, 4)] if m else e for e, m in zip(book, flags)] for book, flags in zip(books, moved)]
        active = vector_codes.Assigner(books, moved).assign(points, codes, dists)
        full = vector_codes.Assigner(books, moved).assign(points, None, None)
        assert all(np.array_equal(a, b) for a, b in zip(active, full))
        codes, dists, _ = active


@pytest.mark.parametrize("huge", [1e5, 3e9, 1e38, 1.7e308])
def test_numbers_of_any_size_are_exact(spark, huge):
    rows = vectors(30, 4, 7)
    rows[3] = (3, [huge, -huge / 3, 1.0, -2.0], 1)
    rows[20] = (20, [0.5, -0.25, -huge, huge / 7], None)
    expected = [(i, c, e if e < 2**63 else None, t if t < 2**63 else None, d) for i, c, e, t, d in brute_force(rows, entries=6)]
    assert found(spark, rows, entries=6) == expected


def test_odd_rows(spark):
    good = vectors(20, 4, 1)
    again = [*good, good[5], good[5], (5, good[6][1], 2), (None, good[7][1], None)]
    bad = [(100, None, 1), (101, [], 1), (102, [1.0, None, 0.0, 0.0], 1), (103, [math.nan, 0.0, 0.0, 0.0], 1),
           (104, [math.inf, 0.0, 0.0, 0.0], 1), (-5, [1.0, 2.0, 3.0], 1), (105, [0.0] * 8, 1)]
    assert found(spark, again + bad, entries=8) == brute_force(again, entries=8)
    assert found(spark, bad[:5]) == [] and found(spark, []) == []
    same = [(i, [0.1, 0.2, 0.3, 0.4], 1) for i in range(300)]
    assert {r[1] for r in found(spark, same)} == {"00000000"}


def test_limbs():
    for value in (0, 1, -1, 2**47, -(2**48), 2**200 + 5, -(2**1030)):
        assert sum(d << (vector_codes.LIMB_BITS * i) for i, d in enumerate(vector_codes.limbs(value))) == value


def test_result_does_not_depend_on_partitions(spark):
    rows = vectors(150, 8, 9)
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    results = [sorted(map(tuple, compress_vectors(df.repartition(k), entries=16).collect())) for k in (1, 7)]
    assert results[0] == results[1]
