"""Packing against the tokenizer itself and against the least number of sequences."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuskit.llm.packing import WordEncoder, completion_plan, pack, placement
from corpuskit.llm.queries import op3_best_fit_packing, table, vocabulary

SF_DIR = "/root/testdata/sf0.001"


TOKENIZER = Tokenizer.from_file(vocabulary())


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, capacity):
    """rows: (key, piece, start, length, sequence, offset, ids) of the documents ``texts`` by key."""
    parts, room = defaultdict(dict), defaultdict(list)
    for key, piece, start, length, sequence, offset, ids in rows:
        parts[key][piece] = (start, list(np.frombuffer(ids, "<u4")))
        assert len(ids) == 4 * length <= 4 * capacity
        room[sequence].append((offset, length))
    for key, text in texts.items():
        whole = plain_ids(text)
        cuts = [parts[key][i] for i in range(len(parts[key]))]
        assert [s for s, _ in cuts] == list(range(0, len(whole), capacity))
        assert [x for _, ids in cuts for x in ids] == whole
    for places in room.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(room)


TEXTS = {0: None, 1: "", 2: "Hello  World's naïve don't", 3: "é ́x İstanbul ΟΔΟΣ\x1cend", 4: "<|endoftext|>a <|startoftext|>",
         5: "word " * 9_000, 6: "a" * 30_000, 7: "Å Å 12345 \t\n\x0b!!! ?x", 8: "日本語 text ßẞ ﬁ"}


def test_words_are_encoded_as_in_their_text(spark):
    rng = random.Random(2)
    letters = "abzABZéÉßñÑüÜÀØøŁłŉǅİıſσΣΟς日本ǰẖ\u0301\u0331"
    marks = [".", ",", "!?", "...", "'s", "'", '".', ").", "-", "’", "½", "²", "3", "_", "<|endoftext|>", "<|ENDOFTEXT|>", ":", ";;"]
    encoder = WordEncoder(vocabulary())
    for _ in range(2_000):
        text = "".join(
            rng.choice(["", " ", "\n", "\xa0"]) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) + rng.choice(["", *marks])
            for _ in range(rng.randint(1, 5)))
        assert list(np.frombuffer(encoder.encode(text.encode()), "<u4")) == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text)


def test_edge_texts(spark):
    rows = [(i, t, "x", 1, "clash") for i, t in TEXTS.items()] + [(None, "no id", "x", 1, None), (2, TEXTS[2], "x", 2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, piece int, _no string")
    got = pack(df, vocabulary())
    picked = [(r.id, r.piece, r.start, r.length, r.sequence_id, r.offset, r.ids) for r in got.collect()]
    assert sum(r[0] is None for r in picked) == 1 and sum(r[0] == 2 for r in picked) == 2
    check(picked, TEXTS, 4096)


@pytest.mark.parametrize("histogram", [{1: 10_000}, {2: 5_000}, {1: 4_000, 2: 3_000, 3: 2_500, 4: 2_000}, {1: 9_000, 700: 3, 4096: 2}])
def test_plan_of_very_many_short_pieces(histogram):
    for nodes in (20_000, 1, 0):
        plan = completion_plan(histogram, nodes=nodes)
        placed = sum((Counter({n: times * k for n, k in step.items()}) for times, step in plan), Counter())
        assert placed == Counter(histogram)
        assert all(sum(n * k for n, k in step.items()) <= 4096 for _, step in plan)
        assert sum(times for times, _ in plan) == -(-sum(n * c for n, c in histogram.items()) // 4096)


def test_very_many_null_texts(spark):
    df = spark.range(10_000).selectExpr("id as doc_id", "cast(null as string) as text")
    got = [(r.id, r.piece, r.start, r.length, r.sequence_id, r.offset, r.ids) for r in pack(df, vocabulary()).collect()]
    assert len(got) == 10_000
    assert check(got, dict.fromkeys(range(10_000)), 4096) == 3


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), vocabulary()).count() == 0


def test_documents(spark):
    documents = table(spark, SF_DIR, "documents")
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = pack(documents, vocabulary(), keep={"ids": F.col("ids"), "crc": F.crc32("ids")}).collect()
    assert all(r.crc == zlib.crc32(r.ids) for r in got)
    used = check([(r.id, r.piece, r.start, r.length, r.sequence_id, r.offset, r.ids) for r in got], texts, 4096)
    total = sum(r.length for r in got)
    assert used <= -(-total // 4096) + 1
    query = {(r.doc_id, r.piece): r.ids_crc32 for r in op3_best_fit_packing(spark, SF_DIR).collect()}
    assert query == {(r.id, r.piece): r.crc for r in got}


def fewest(items, capacity):
    """Least number of bins, by trying all."""
    best = len(items)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for at in range(len(bins)):
            if bins[at] + rest[0] <= capacity:
                bins[at] += rest[0]
                place(rest[1:], bins)
                bins[at] -= rest[0]
        place(rest[1:], [*bins, rest[0]])

    place(sorted(items, reverse=True), [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    plan = completion_plan(dict(Counter(items)), capacity)
    assert sum((Counter({n: times * k for n, k in step.items()}) for times, step in plan), Counter()) == Counter(items)
    assert all(sum(n * k for n, k in step.items()) <= capacity for _, step in plan)
    assert sum(times for times, _ in plan) == fewest(items, capacity)


def test_plan_of_many_pieces_is_short():
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 10**9) for n in range(1, 4097)}
    plan = completion_plan(histogram)
    total = sum(n * c for n, c in histogram.items())
    used = sum(times for times, _ in plan)
    assert len(plan) <= 2 * 4096 and used <= 1.01 * -(-total // 4096)
    rows = placement(plan)
    ends = Counter()
    for length, first, end, *_ in rows:
        assert first == ends[length]
        ends[length] = end
    assert ends == histogram
    assert list(itertools.islice(rows, 1))[0][3] == 0
