"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from corpuskit.llm import importance
from corpuskit.llm.queries import op13_importance_resampling, table

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, weight string, rank int"


def features(text, longest=1):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_force(rows, target, longest=1, buckets=10_000, least_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: Counter(bucket(f) for t in texts for f in features(t, longest)[1])
    s, t = count(text for _, text in rows), count(target)
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for at, (i, text) in enumerate(rows):
        words, own = features(text, longest)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, row in enumerate(fit[: len(fit) * percent // 100], 1):
        row[5] = place
    return sorted(map(tuple, out), key=str)


def found(spark, rows, target, **how):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, importance.resample(df, wanted, **how).collect()), key=str)


def test_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, SF_DIR, "benchmark").collect()]
    expected = [(i, n, weight, score, rank) for i, _, n, weight, score, rank in brute_force(docs, target)]
    assert sorted(map(tuple, op13_importance_resampling(spark, SF_DIR).collect()), key=str) == sorted(expected, key=str)
    assert sum(r[4] is not None for r in expected) > 5


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "Über", "naïve", "x1", "ÄÖ", "日本", "a", "it's", "end-of", "Z"]
    return [(i, rng.choice([" ", "\t", ". ", "\x7f", " "]).join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 97)])
def test_equals_brute_force(spark, longest, buckets):
    rows, target = texts(150, 1), [t for _, t in texts(20, 2)]
    how = {"longest": longest, "buckets": buckets, "percent": 30}
    assert found(spark, rows, target, **how) == brute_force(rows, target, **how)


def test_chained_hashes_are_those_of_the_joined_words():
    hasher = importance.Hasher(3)
    words = importance.words_of("Aa bb, CC dd aa".encode())
    assert words == [b"aa", b"bb", b"cc", b"dd", b"aa"]
    assert hasher.features(words) == Counter(zlib.crc32(f.encode()) for f in features("Aa bb, CC dd aa", 3)[1])


def test_odd_rows(spark):
    long = "Word " * 200_000
    rows = [(1, None), (2, ""), (3, "... !"), (None, "many words " * 20), (None, "many words " * 20), (7, "same text here " * 10), (7, "same text here " * 10),
            (8, long), (9, "few words")]
    assert found(spark, rows, ["many words", None, ""], percent=50) == brute_force(rows, ["many words", None, ""], percent=50)
    assert found(spark, rows, [], percent=100) == brute_force(rows, [], percent=100)
    assert found(spark, [], ["x"]) == []
    assert {r[5] for r in found(spark, rows, ["x"], percent=0)} == {None}


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(importance, "noise", lambda *a: 0)
    rows = [(i, "equal words " * 15) for i in (5, 3, 9, 1)]
    assert {r[0]: r[5] for r in found(spark, rows, ["x"], percent=75)}.keys() == {1, 3, 5, 9}
