"""The pipeline against each stage done in plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_jaccard import by_pairs
from test_packing import plain_ids

import __spark_entry__ as contract
import corpus_pipeline
from corpuskit.llm import mixing
from corpuskit.llm.queries import table

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    docs, out = table(spark, SF_DIR, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def test_stages(kept):
    assert list(kept) == ["identify_language", "drop_exact_copies", "drop_near_copies", "mix_sources", "pack_sequences"]
    for name in list(kept)[:-1]:
        assert list(kept[name][0].asDict()) == COLUMNS


def test_language_id_keeps_clean_documents(spark, kept):
    texts = [r.text for r in table(spark, SF_DIR, "documents").collect()]
    lettered = [t for t in texts if t and re.search(r"[^\W\d_]", t)]
    assert len(kept["identify_language"]) >= 0.99 * len(lettered)


def test_exact_copies_go(kept):
    least = {}
    for r in kept["identify_language"]:
        key = re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")
        least[key] = min(r.doc_id, least.get(key, r.doc_id))
    assert sorted(r.doc_id for r in kept["drop_exact_copies"]) == sorted(least.values())


def test_near_copies_go(kept):
    rows = sorted((r.doc_id, r.text) for r in kept["drop_exact_copies"])
    roots, _, _ = by_pairs(rows, 5, 80)
    assert sorted(r.doc_id for r in kept["drop_near_copies"]) == [rows[i][0] for i in sorted(set(roots))]
    assert len(set(roots)) < len(rows)


def test_mix_keeps_all_in_order(spark, kept):
    before, after = kept["drop_near_copies"], kept["mix_sources"]
    assert sorted(before) == sorted(after)
    mixed = mixing.mix_sources(spark.createDataFrame(before)).collect()
    place = {r.id: (r.slot, r.before) for r in mixed}
    order = [place[r.doc_id] for r in after]
    assert order == sorted(order)


def test_packed_pieces(kept):
    pieces = Counter(r.doc_id for r in kept["pack_sequences"])
    sizes = {r.doc_id: len(plain_ids(r.text)) for r in kept["mix_sources"]}
    assert pieces == {i: -(-n // 4096) for i, n in sizes.items()}
    total = sum(r.length for r in kept["pack_sequences"])
    assert total == sum(sizes.values())
    assert len({r.sequence_id for r in kept["pack_sequences"]}) <= -(-total // 4096) + 1


def test_run_is_the_stages_in_a_row(spark, kept):
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    same = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert same(corpus_pipeline.run(spark, SF_DIR).collect()) == same(kept["pack_sequences"])


def test_sequences_follow_the_mix(spark):
    """A source of long documents and one of short ones keep their shares along the sequences."""
    rows = [(i, "some words of text " * 800, "en", "long", 0) for i in range(160)]
    rows += [(1000 + i, "some words of text " * (20 + i % 9), "en", "short", 0) for i in range(5300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    got = corpus_pipeline.pack_sequences(spark, docs, SF_DIR).collect()
    last = max(r.sequence_id for r in got)
    assert {r.sequence_id for r in got} == set(range(last + 1))
    share = sum(r.length for r in got if r.doc_id < 1000) / sum(r.length for r in got)
    for quarter in range(4):
        part = [r for r in got if 4 * r.sequence_id // (last + 1) == quarter]
        assert abs(sum(r.length for r in part if r.doc_id < 1000) / sum(r.length for r in part) - share) < 0.2


def test_odd_rows_pass_through_all_stages(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!! 123", "en", "a", 7), (None, "some words without an id", None, "b", 3),
            (4, "the text of a document", "en", None, 1), (4, "the text of a document", "en", None, 1), (5, "the  text of a document", "en", "a", 1),
            (6, "the long text " * 50_000, "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    wide = docs.withColumns({c: F.lit("clash") for c in ("id", "row", "slot", "kept", "digest", "found", "_no", "text_sha256")})
    for frame in (docs, wide, docs.limit(0), docs.where("doc_id = 1")):
        part = frame
        for _, stage in corpus_pipeline.STAGES:
            part = stage(spark, part, SF_DIR)
        got = sorted((r.doc_id for r in part.collect()), key=repr)
        if frame.limit(1).count() and frame.count() > 1:
            assert [i for i in got if i != 6] == [4, None] and got.count(6) == -(-len(plain_ids(rows[-1][1])) // 4096)
        else:
            assert got == []
