"""Removal of repeated strings against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuskit.llm import suffix_dedup
from corpuskit.llm.queries import op8_suffix_array_dedup, table
from corpuskit.llm.suffix_dedup import common_prefixes, pieces_of, remove_repeats, sliding_least, suffix_array


def by_count(texts, length):
    """[(removed runs, kept)] by counting every string of ``length`` bytes."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = suffix_dedup.runs_of(gone)
        out.append(([(a, b + 1) for a, b in runs], bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def check(spark, rows, length=400, **how):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, t string, kept int").repartition(3)
    texts = [(t or "").encode() for _, t in rows]
    expected = sorted(((i, len(t), spans, kept) for (i, _), t, (spans, kept) in zip(rows, texts, by_count(texts, length))), key=repr)
    got = [(r.id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in remove_repeats(df, length=length, **how).collect()]
    assert sorted(got, key=repr) == expected
    return sum(len(spans) for *_, spans, _ in expected)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é", "日本", "word"]) + str(rng.randint(0, 99)) for _ in range(n))


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [words(rng, rng.randint(40, 120)) for _ in range(6)]
    rows = []
    for _ in range(n):
        parts = [words(rng, rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            cut = rng.randint(0, len(passage) // 3)
            parts += [passage[cut:] if rng.random() < 0.5 else passage.replace("alpha", "omega", rng.randint(0, 2)), words(rng, rng.randint(0, 60))]
        rows.append(" ".join(parts))
    rows += rows[:5]
    return list(enumerate(rows))


@pytest.mark.parametrize("how", [{}, {"per_shard": 2}], ids=["one shard per anchor", "spread anchors"])
def test_against_counting(spark, how):
    assert check(spark, corpus(1), **how) > 40


def shard_of(pieces, salt):
    return pa.table({"h": [1] * len(pieces), "salt": [salt] * len(pieces), "piece": pa.array(pieces, pa.binary())})


@pytest.mark.parametrize("length", [100, 400])
def test_contexts_are_held_by_all_strings_of_their_range(length):
    rng = random.Random(length)
    text = bytes(rng.choice(b"abc ") for _ in range(5_000))
    for first, last in list(zip(*pieces_of(text, length)[1:]))[:40]:
        piece = text[first : last + length]
        at = suffix_dedup.anchor_place(piece, length)
        for width in suffix_dedup.STEPS:
            contexts = suffix_dedup.shared_contexts(piece, length, width)
            for start in range(len(piece) - length + 1):
                string, reach = piece[start : start + length], at - start
                assert contexts[reach // width] in string
                if width == 1:
                    assert contexts[reach] == string


def test_a_shard_publishes_few_prints_of_pieces_that_share_little():
    """Surroundings differ, so no print but those of the common string goes on to the next step."""
    rng = random.Random(5)
    string = bytes(rng.randrange(256) for _ in range(420))
    shards = [[rng.randbytes(250) + string + rng.randbytes(250) for _ in range(200)] for _ in range(2)]
    shards = [[p[f : e + 400] for p in s for h, f, e in zip(*pieces_of(p)) if f <= 260 <= e] for s in shards]
    shared, rows = None, []
    for step in range(3):
        made = [suffix_dedup._publish(shard_of(s, i), shared, 400, step) for i, s in enumerate(shards)]
        both = set(made[0].column("print").to_pylist()) & set(made[1].column("print").to_pylist())
        shared = pa.table({"print": pa.array(sorted(both), pa.binary())})
        rows.append([m.num_rows for m in made])
    assert max(rows[0]) <= 200 * 8 and max(rows[1]) <= 200 * 12 and max(rows[2]) <= 200 * 16
    strings = [{p[i : i + 400] for p in s for i in range(len(p) - 399)} for s in shards]
    assert set(made[0].column("string").to_pylist()) & set(made[1].column("string").to_pylist()) == strings[0] & strings[1]
    assert len(both) == len(strings[0] & strings[1]) >= 21


def test_binary_search_finds_all_places():
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    data, ends = b"".join(pieces), np.cumsum([len(p) for p in pieces])
    order = suffix_array(np.frombuffer(data, np.uint8), ends)
    starts = np.concatenate([[0], ends[:-1]])
    for string in [b"a", b"ab\x00", b"\x00\x00", b"bbbb", b"c", data[:9]]:
        expected = [int(s) + i for s, p in zip(starts, pieces) for i in range(len(p)) if p[i : i + len(string)] == string]
        assert sorted(suffix_dedup.places_of([string], data, ends, order)) == expected


def test_a_hot_anchor_of_thousands_of_pieces(spark):
    rng = random.Random(16)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(405))
    rows = [(i, f"{rng.random():.15f}" * 12 + passage + f"{rng.random():.15f}" * 12) for i in range(2_500)]
    assert check(spark, rows, per_shard=200) >= 2_500


def test_a_string_of_very_many_documents(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(410))
    rows = [(i, f"{i:04d}" * 20 + passage + f"{i:05d}" * 20) for i in range(600)] + [(i, words(rng, 80)) for i in range(600, 620)]
    assert check(spark, rows, per_shard=16) >= 600


def test_shorter_strings(spark):
    assert check(spark, corpus(2, 40), length=100) > 40


def test_odd_rows(spark):
    rng = random.Random(4)
    base = words(rng, 90)
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 399), (5, "a" * 400), (6, "a" * 401), (7, "b" * 3_000), (8, base), (8, base), (None, base),
            (9, "x" + base + "y"), (10, base[:420]), (None, None), (11, "é" * 500), (12, "\x00" * 900), (13, ("ab" * 150 + "c") * 9),
            (14, words(rng, 100) + "\x00" * 450), (15, base[:399])]
    check(spark, rows)


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    rng = random.Random(5)
    passage = words(rng, 300)
    check(spark, [(1, words(rng, 900) + passage + words(rng, 700)), (2, words(rng, 333) + passage), (3, passage + words(rng, 10) + passage)])


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_on_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    texts = [(r.text or "").encode() for r in rows]
    expected = {r.doc_id: (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                for r, t, (spans, kept) in zip(rows, texts, by_count(texts, 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix_array_dedup(spark, sf_dir).collect()}
    assert got == expected


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    alphabet = bytes(rng.sample(range(256), rng.choice([1, 2, 3, 20]))) + b"\x00"
    pieces = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(1, 12))]
    data, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces])
    order = suffix_array(data, ends)
    # An end sorts before any byte, and by its piece.
    suffixes, at = {}, 0
    for number, piece in enumerate(pieces):
        for i in range(len(piece)):
            suffixes[at + i] = [256 + c for c in piece[i:]] + [number]
        at += len(piece)
    assert order.tolist() == sorted(suffixes, key=suffixes.get)
    shared = common_prefixes(data, ends, order)
    for i in range(1, len(order)):
        a, b = suffixes[order[i - 1]], suffixes[order[i]]
        n = 0
        while a[n] == b[n]:
            n += 1
        assert shared[i] == n


def test_pieces_cover_all_starts_and_agree():
    rng = random.Random(8)
    shared = words(rng, 200).encode()
    texts = [words(rng, rng.randint(1, 300)).encode() + shared + words(rng, 50).encode() for _ in range(5)]
    anchors = []
    for t in texts:
        h, first, last = pieces_of(t)
        assert first[0] == 0 and last[-1] == len(t) - 400 and (first[1:] == last[:-1] + 1).all()
        of_start = np.repeat(h, last - first + 1)
        at = t.find(shared)
        anchors.append(of_start[at : at + len(shared) - 399].tolist())
    assert all(a == anchors[0] for a in anchors)


def test_sliding_least():
    rng = np.random.default_rng(1)
    for n, width in [(5, 5), (17, 4), (100, 7), (64, 64), (65, 1)]:
        v = rng.integers(0, 50, n).astype(np.uint64)
        assert sliding_least(v, width).tolist() == [int(v[i : i + width].min()) for i in range(n - width + 1)]
