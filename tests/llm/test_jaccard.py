"""The n-gram join against comparing all pairs."""

import random

import numpy as np
import pytest

from corpuskit.llm import jaccard
from corpuskit.llm.components import components
from corpuskit.llm.jaccard import drop_near_copies, jaccard_components, least_overlap
from corpuskit.llm.queries import op6_ngram_jaccard_join, table

SF_DIR = "/root/testdata/sf0.001"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def by_pairs(rows, width, percent):
    """{index: component} by comparing all pairs; the component is the list of its indices."""
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    links += 1
                    a, b = sorted((root(i), root(j)))
                    label[b] = a
    return [root(i) for i in range(len(rows))], sets, links


def check(spark, rows, width=4, percent=85):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, node string, n int").repartition(3)
    roots, sets, links = by_pairs(rows, width, percent)
    groups = {}
    for (i, _), r in zip(rows, roots):
        groups.setdefault(r, []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    expected = sorted(((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, roots)), key=repr)
    got = [(r.id, r.n_shingles, r.component_id) for r in jaccard_components(df, width=width, percent=percent).collect()]
    assert sorted(got, key=repr) == expected
    return links


def mutated(rng, words, share):
    return [rng.choice("abcdefgh") * 3 + str(rng.randint(0, 999)) if rng.random() < share else w for w in words]


def corpus(seed, families, copies, share, vocabulary=40):
    """Families of mutated copies, sharing words and one passage."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for f in range(families):
        base = [f"w{rng.randint(0, vocabulary)}" for _ in range(rng.randint(20, 150))] + (passage if f % 2 else [])
        for _ in range(copies):
            rows.append(" ".join(mutated(rng, base, rng.random() * share)))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_against_all_pairs(spark, seed, width, percent):
    assert check(spark, corpus(seed, 12, 12, 0.06), width, percent) > 50


def test_many_tiles(spark, monkeypatch):
    """One large family whose copies hardly link, cut into many bands."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 8)
    assert check(spark, corpus(7, 1, 150, 0.05)) > 50


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE "), (6, "one two"), (7, "two one"), (8, "é É x y z"), (9, "É é x y z"),
            (10, "a b c d e"), (10, "a b c d e"), (10, "q r s t u"), (11, "q R\x0bs t\x0cu"), (None, "a b c d e"), (None, "lone text of no id"),
            (None, "lone text of no id"), (12, "x y z"), (13, "long " * 100_000), (14, "many words " * 50_000), (15, " ".join(map(str, range(30_000)))),
            (16, " ".join(map(str, range(30_100))))]
    check(spark, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, row int")
    assert jaccard_components(df).count() == 0 and drop_near_copies(df).count() == 0


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").orderBy("doc_id").collect()]
    roots, sets, _ = by_pairs(rows, 4, 85)
    expected = {i: (len(s), rows[r][0]) for (i, _), s, r in zip(rows, sets, roots)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_ngram_jaccard_join(spark, SF_DIR).collect()}
    assert got == expected


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base), (3, base + " tail"), (None, base + " other"), (3, "unlike all the other texts here"), (7, None), (8, None), (9, "solo text with six words here")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, digest string")
    kept = drop_near_copies(df)
    assert kept.schema.names == df.schema.names
    assert sorted(r.doc_id for r in kept.collect()) == [3, 3, 7, 8, 9]
    assert base + " tail" in {r.text for r in kept.collect()}


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        x, y = (jaccard.bitmap(s) for s in (a, b))
        both = len(np.intersect1d(a, b))
        assert jaccard.overlap(a, b) == both
        n, m = np.int64(len(a)), np.int64(len(b))
        if both >= least_overlap(n, m, 85):
            assert jaccard.bounded_pairs([x], [y], np.array([n]), np.array([m]), 85)[0]
            assert jaccard.tile_bound([x], [y], np.array([0]), np.array([0]), np.array([n]), np.array([m]), 85)[0]


def test_folded_bitmap_is_the_smaller_one():
    items = np.unique(np.random.default_rng(1).integers(0, 2**64, 200, dtype=np.uint64))
    small = jaccard.bitmap(items)
    flags = np.zeros(2048, bool)
    flags[(items >> np.uint64(53)).astype(int)] = True
    large = np.packbits(flags, bitorder="little").view(np.uint64)[None]
    assert len(small) == 128 and jaccard.halved(large).tobytes() == small


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(200, 260)] + [(7, i) for i in range(8, 60)] + [(9, 3), (500, 500), (8, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 200 for i in range(200, 261)}, **{i: 3 for i in [3, *range(7, 60)]}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
