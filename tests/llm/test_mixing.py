"""Mixing against a step-by-step schedule, and the bound on its deviation."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpuskit.llm.mixing import in_mixed_order, mix_sources, whole_shares
from corpuskit.llm.queries import op7_mixing, table

SCHEMA = "doc_id bigint, text string, source string, block int, _name string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "clash", 2) for i, t, s in rows], SCHEMA)


def schedule(shares, places):
    """Earliest deadline first, one place after another: [(source, block)]."""
    whole, had, out = sum(shares), [0] * len(shares), []
    for place in range(places):
        ready = [(math.ceil((k + 1) * whole / w), i) for i, (k, w) in enumerate(zip(had, shares)) if k * whole // w <= place]
        _, i = min(ready)
        out.append((i, had[i]))
        had[i] += 1
    return out


@pytest.mark.parametrize("shares", [[1], [1, 1], [5, 3, 2], [1, 9], [7, 7, 7, 1], [13, 1, 1, 1, 4]])
def test_slots_follow_the_schedule(spark, shares):
    names = [f"s{i}" for i in range(len(shares))]
    # One document of exactly one block each, for three frames.
    rows = [(1000 * i + k, "x" * 10, names[i]) for i, w in enumerate(shares) for k in range(3 * w)]
    got = mix_sources(frame(spark, rows), weights=dict(zip(names, shares)), block_chars=10).collect()
    order = {r.slot: (names.index(r.source), r.block) for r in got}
    expected = schedule(shares, 3 * sum(shares))
    assert [order[t] for t in range(len(expected))] == expected
    assert all(r.exact and r.release <= r.slot < r.deadline for r in got)
    had = Counter()
    for t, (i, _) in enumerate(expected, 1):
        had[i] += 1
        assert all(abs(had[j] - w * t / sum(shares)) < 1 for j, w in enumerate(shares))


def test_more_sources_than_places(spark):
    rows = [(i, "x" * (10 + i % 3), f"s{i % 1500:04d}") for i in range(3000)]
    got = mix_sources(frame(spark, rows), block_chars=10).select("source", "block", "slot", "release", "deadline").collect()
    assert len(got) == 3000 and len({r.source for r in got}) == 1500
    first = {r.slot: r.source for r in got if r.block == 0}
    assert len(first) == 1500 and max(first) < 3000
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_documents_fall_into_blocks_by_size(spark):
    rows = [(1, "a" * 25, "x"), (2, "b" * 3, "x"), (3, None, "x"), (3, None, "x"), (None, "c" * 4, "x"), (4, "", None), (5, "d" * 9, None),
            (6, "e" * 100_000, "y")]
    got = mix_sources(frame(spark, rows), block_chars=10, frame=30).collect()
    assert len(got) == len(rows)
    blocks = defaultdict(list)
    for r in got:
        blocks[r.source].append((r.id, r.before, r.block))
    assert sorted(blocks["x"], key=repr) == sorted([(1, 0, 0), (2, 25, 2), (3, 28, 2), (3, 28, 2), (None, 28, 2)], key=repr)
    assert sorted(blocks[None]) == [(4, 0, 0), (5, 0, 0)]


def test_end_of_a_source_ends_the_exact_part(spark):
    rows = [(i, "x" * 10, "big") for i in range(50)] + [(100 + i, "x" * 10, "small") for i in range(5)]
    got = mix_sources(frame(spark, rows), weights={"big": 1, "small": 1}, block_chars=10).collect()
    assert len(got) == 55
    assert Counter((r.source, r.exact) for r in got) == {("big", True): 5, ("small", True): 5, ("big", False): 45}


def test_natural_weights_use_all_sources_up_together(spark):
    rows = [(i, "x" * 10, f"s{i % 4 if i % 3 else 0}") for i in range(1200)]
    got = mix_sources(frame(spark, rows), block_chars=10, frame=1200).collect()
    assert max(r.slot for r in got) < 1210
    ordered = in_mixed_order(frame(spark, rows), block_chars=10, frame=1200)
    assert ordered.schema.names == SCHEMA.replace(",", "").split()[::2] and ordered.count() == 1200
    half = Counter(r.source for r in ordered.limit(600).collect())
    total = Counter(s for _, _, s in rows)
    assert all(abs(half[s] - total[s] / 2) <= 2 for s in total)


def test_refused_input(spark):
    df = frame(spark, [(1, "x", "a"), (2, "y", "b")])
    with pytest.raises(ValueError, match="no weight"):
        mix_sources(df, weights={"a": 3})
    assert sorted(r.slot for r in mix_sources(df, frame=1).collect()) == [0, 1]  # the frame grows with the sources
    assert mix_sources(df.limit(0)).count() == 0


def test_shares():
    assert whole_shares({"a": 1.0, "b": 0.0}, 10) == {"a": 9, "b": 1}
    shares = whole_shares({f"s{i}": (i + 1) ** 3 for i in range(17)}, 1000)
    assert sum(shares.values()) == 1000 and min(shares.values()) >= 1


def test_hot_source_is_spread_and_no_python(spark):
    rows = [(i, "x" * 10, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    plan = mix_sources(frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_query_on_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = op7_mixing(spark, sf_dir).collect()
    documents = {r.doc_id: r for r in table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n")).collect()}
    assert {(r.doc_id, r.source, r.n_chars) for r in got} == {(r.doc_id, r.source, r.n) for r in documents.values()}
    before = Counter()
    for r in sorted(got, key=lambda r: r.doc_id):
        assert r.before == before[r.source] and r.block == r.before // (1 << 18)
        before[r.source] += r.n_chars
        assert r.release <= r.slot < r.deadline
