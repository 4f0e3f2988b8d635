"""Language identification: held-out accuracy, the backoff, and odd rows."""

import functools
import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import language_id, sampling
from corpuskit.llm.queries import held_out, op1_language_id, table

SF_DIR = "/root/testdata/sf0.001"
SENTENCES = {"en": "the house of the king is the home that they have", "de": "das haus und der könig ist nicht die ware",
             "fr": "la maison du roi est une chose que nous avons"}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, text, lang) for i in range(20) for lang, text in SENTENCES.items()] + [(1, None, "en"), (2, "text", None)]
    return language_id.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_held_out_accuracy(spark):
    got = op1_language_id(spark, SF_DIR).join(table(spark, SF_DIR, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == table(spark, SF_DIR, "documents").count()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_fold_is_crc32_of_the_id(spark):
    got = spark.range(500).select("id", held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
    assert spark.sql("select cast(null as bigint) as id").select(held_out(F.col("id"))).first()[0] is False


def test_words_then_shorter_and_shorter_grams(model):
    assert (model.word_scores("haus") == model.words["haus"]).all()
    assert "hausware" not in model.words
    longest = [model.grams[g] for g in language_id.grams_of("hausware", 5) if g in model.grams]
    assert longest and np.allclose(model.word_scores("hausware"), np.mean(longest, axis=0))
    assert not any(g in model.grams for n in (2, 3, 4, 5) for g in language_id.grams_of("zzzö", n))
    assert np.allclose(model.word_scores("zzzö"), model.grams["ö"])
    assert not model.word_scores("жжж").any()


def test_log_frequencies(model):
    en, word = model.langs.index("en"), "the"
    total = np.exp(model.words.table[:, en].astype(float)).sum()
    assert total == pytest.approx(1.0, rel=1e-5) and model.words[word].argmax() == en


def test_odd_texts(spark, model):
    texts = {1: None, 2: "", 3: "123 ... ²", 4: "könig", 5: "The KING of the home " * 20_000, 6: "жжж", 7: "a"}
    rows = [(i, t, "clash", 5.0) for i, t in texts.items()] + [(None, "das haus", "x", 0.0), (4, "könig", "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string, score double")
    got = [(r.id, r.lang_pred, r.score) for r in language_id.identify_languages(df, model).collect()]
    by_id = {i: (lang, score) for i, lang, score in got}
    assert len(got) == 9 and by_id[1] == by_id[2] == by_id[3] == ("und", 0.0)
    assert by_id[4][0] == by_id[None][0] == "de" and by_id[5][0] == "en" and by_id[5][1] > 0.99
    assert by_id[6] == (model.langs[0], pytest.approx(1 / 3))
    kept = language_id.drop_unidentified(df, model)
    assert kept.schema.names == df.schema.names
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id != 7) == [4, 4, 5]


def test_no_labels_and_no_rows(spark):
    schema = "doc_id bigint, text string, lang string"
    nothing = language_id.fit_languages(spark.createDataFrame([(1, "text", None)], schema))
    df = spark.createDataFrame([(1, "some text", "en")], schema)
    assert language_id.identify_languages(df, nothing).first().lang_pred == "und"
    assert language_id.identify_languages(df.limit(0), nothing).count() == 0
    assert language_id.fit_languages(df.limit(0)).langs == []


def test_sample_and_model_are_bounded(spark):
    rows = [(i, f"word{chr(97 + i % 26)} shared text", "en") for i in range(400)]
    model = language_id.fit_languages(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model_words=3, model_grams=5)
    assert len(model.words) == 3 and len(model.grams) == 5 and {"shared", "text"} < set(model.words.names)


def plain_model(rows):
    """Words and n-grams by (language, name), counted in plain Python over the different labelled texts."""
    words, grams = Counter(), Counter()
    for text, lang in {(t, lang) for t, lang in rows if t is not None and lang is not None}:
        found = re.findall(r"[^\W\d_]+", text.lower())
        words.update((lang, w) for w in found)
        for w in found:
            for n in range(1, 6):
                marked = f"<{w}>" if n > 1 else w
                grams.update((lang, marked[i : i + n]) for i in range(len(marked) - n + 1))
    return words, grams


def test_all_predictions_equal_a_plain_computation(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text", "lang").collect()
    train = [(r.text, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    words, grams = plain_model(train)
    langs = sorted({lang for lang, _ in words})
    known_words, known_grams = {w for _, w in words}, {g for _, g in grams}
    word_total = {lang: sum(words[lang, w] + 0.5 for w in known_words) for lang in langs}
    gram_total = {(lang, n): 0.0 for lang in langs for n in range(1, 6)}
    for g in known_grams:
        for lang in langs:
            gram_total[lang, len(g)] += grams[lang, g] + 0.5

    @functools.cache
    def score(word):
        if word in known_words:
            return [math.log((words[lang, word] + 0.5) / word_total[lang]) for lang in langs]
        for n in range(min(5, len(word) + 2), 0, -1):
            found = [g for g in language_id.grams_of(word, n) if g in known_grams]
            if found:
                return [sum(math.log((grams[lang, g] + 0.5) / gram_total[lang, n]) for g in found) / len(found) for lang in langs]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in op1_language_id(spark, SF_DIR).collect()}
    for r in docs:
        found = re.findall(r"[^\W\d_]+", r.text.lower())
        sums = [sum(x) for x in zip(*map(score, found))]
        scaled = [x * min(1.0, 50 / len(found)) for x in sums]
        belief = [math.exp(x - max(scaled)) for x in scaled]
        assert got[r.doc_id].lang_pred == langs[belief.index(max(belief))]
        assert got[r.doc_id].score == pytest.approx(max(belief) / sum(belief), abs=1e-4)


def test_common_texts_are_folded_and_the_sample_never_runs_out(spark):
    rows = [(i, "same text again", "en") for i in range(3000)] + [(5000 + i, f"wort{i} der liste", "de") for i in range(5)]
    model = language_id.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert np.exp(model.words["same"]).argmax() == 1 and np.exp(model.words["der"][0] - model.words["liste"][0]) == pytest.approx(1)
    assert "wort" in model.words and len(model.words) == 6
    for rows in (10, 10**6, 10**12, 10**16):
        assert sampling.threshold(20_000, rows) * rows / sampling.GRID == pytest.approx(min(rows, 20_000), rel=1e-3)


def test_model_travels_compactly(model):
    again = pickle.loads(pickle.dumps(model))
    assert again.words.names == model.words.names and (again.grams["ö"] == model.grams["ö"]).all()
    empty = pickle.loads(pickle.dumps(language_id.Frequencies([], np.empty((0, 0), np.float32))))
    assert len(empty) == 0 and "x" not in empty
