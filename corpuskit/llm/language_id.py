"""Language identification: known words first, then ever shorter character n-grams.

A word of the training sample scores by its log frequency in each language. Any other word falls
back to the longest character n-grams of it that the sample knows, down to single characters.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.sampling import picked

WORDS = re.compile(r"[^\W\d_]+")
LONGEST = 5
SMOOTHING = 0.5
NO_LANGUAGE = "und"
RESULT = "lang_pred string, score double"

# The sample and the model have these bounds, whatever the size of the corpus.
SAMPLE_DOCS = 20_000
MODEL_WORDS = 200_000
MODEL_GRAMS = 200_000
# Words (or n-grams) times languages: with many languages the model knows fewer words of each.
MODEL_NUMBERS = 4_000_000
MEMO_WORDS = 100_000
# Words beyond this number make a verdict no surer.
EVIDENCE_WORDS = 50


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked; for n = 1 the bare letters."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Frequencies:
    """Log frequencies of names (words or n-grams) per language, as one matrix with a row per name.

    Copies that are sent to workers hold the names as one text; each worker numbers them once.
    """

    names: list[str]
    table: np.ndarray
    rows: dict[str, int] = field(init=False, repr=False)

    def __post_init__(self):
        self.rows = {name: i for i, name in enumerate(self.names)}

    def __getstate__(self):
        return "\n".join(self.names), self.table  # no name holds a line end

    def __setstate__(self, state):
        names, self.table = state
        self.names = names.split("\n") if len(self.table) else []
        self.__post_init__()

    def __len__(self) -> int:
        return len(self.names)

    def __contains__(self, name: str) -> bool:
        return name in self.rows

    def __getitem__(self, name: str) -> np.ndarray:
        return self.table[self.rows[name]]


@dataclass
class LanguageModel:
    """Log frequencies per language (columns, in the order of ``langs``) of words and n-grams."""

    langs: list[str]
    words: Frequencies
    grams: Frequencies

    def word_scores(self, word: str) -> np.ndarray:
        """Per language; words that nothing is known of count for no language."""
        if word in self.words:
            return self.words[word]
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [at for at in map(self.grams.rows.get, grams_of(word, n)) if at is not None]
            if found:
                return self.grams.table[found].mean(axis=0, dtype=np.float64)
        return np.zeros(len(self.langs))

    def verdict(self, total: np.ndarray, words: int) -> tuple[str, float]:
        """Language and its share of the belief, from the sum of the words' scores."""
        scaled = total * min(1.0, EVIDENCE_WORDS / words)
        belief = np.exp(scaled - scaled.max())
        best = int(belief.argmax())  # the first in alphabetical order on a tie
        return self.langs[best], float(belief[best] / belief.sum())


class Scorer:
    """Scores whole texts; remembers the scores of words while a task runs."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)))

    def _learn(self, word: str) -> int:
        at = len(self.memo)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.model.word_scores(word)
        self.memo[word] = at
        return at

    def score(self, text: str | None) -> tuple[str, float]:
        found = [] if text is None else words_of(text)
        if not found or not self.model.langs or not any(c.isalpha() for c in (found[0] if found[0].isalpha() else text)):
            return NO_LANGUAGE, 0.0
        if len(self.memo) > MEMO_WORDS:
            self._clear()
        memo, learn = self.memo, self._learn
        at = [memo[w] if w in memo else learn(w) for w in found]
        return self.model.verdict(self.table[at].sum(axis=0), len(found))


def _count_words(batches):
    for batch in batches:
        counts: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0), batch.column(1)):
            counts.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
        rows = [(lang, word, n) for lang, found in counts.items() for word, n in found.items()]
        yield pa.RecordBatch.from_pydict(dict(zip(("lang", "word", "n"), map(list, zip(*rows))))) if rows else _no_counts()


def _no_counts():
    return pa.RecordBatch.from_pydict({"lang": pa.array([], pa.string()), "word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})


def _count_grams(batches):
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, times in zip(*(c.to_pylist() for c in batch.columns)):
            for n in range(1, LONGEST + 1):
                for gram in grams_of(word, n):
                    counts[lang, gram] += times
        rows = [(lang, gram, n) for (lang, gram), n in counts.items()]
        yield pa.RecordBatch.from_pydict(dict(zip(("lang", "word", "n"), map(list, zip(*rows))))) if rows else _no_counts()


def _frequencies(counts: DataFrame, langs: list[str], most: int, kind_of) -> Frequencies:
    """Log frequencies of the ``most`` frequent words (or n-grams) from rows (lang, word, n).

    Each kind of name has a total of its own. Names and counts reach the driver as Arrow columns, a few bytes a number.
    """
    most = max(1, min(most, MODEL_NUMBERS // max(1, len(langs))))
    each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    wide = counts.groupBy("word").agg(F.sum("n").alias("n"), *each)
    found = wide.orderBy(F.desc("n"), "word").limit(most).drop("n").toArrow()
    names = found.column("word").to_pylist()
    kinds = np.fromiter(map(kind_of, names), np.int64, len(names))
    table = np.empty((len(names), len(langs)), np.float32)
    for i in range(len(langs)):
        numbers = found.column(f"n{i}").to_numpy() + SMOOTHING
        table[:, i] = np.log(numbers / np.bincount(kinds, numbers)[kinds]) if len(names) else 0
    return Frequencies(names, table)


def fit_languages(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    model_words: int = MODEL_WORDS,
    model_grams: int = MODEL_GRAMS,
) -> LanguageModel:
    """A model from labelled rows: about ``sample_docs`` different ones, picked by the hash of text and label.

    Rows without text or label teach nothing, and equal ones teach once, however common they are. At most ``model_words`` words and ``model_grams`` n-grams
    are kept, the most frequent ones, also those that occur once; above 20 languages fewer (``MODEL_NUMBERS``). Without
    labelled rows the model knows no language.
    """
    labelled = df.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    labelled = labelled.where("text is not null and lang is not null")
    rows = df.where(F.col(f"`{lang_col}`").isNotNull()).count()
    different = labelled.where(picked(["text", "lang"], sample_docs, rows)).dropDuplicates(["lang", "text"])
    counts = different.mapInArrow(_count_words, "lang string, word string, n bigint")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    try:
        langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
        words = _frequencies(counts, langs, model_words, lambda word: 0)
        grams = _frequencies(counts.mapInArrow(_count_grams, "lang string, word string, n bigint"), langs, model_grams, len)
    finally:
        counts.unpersist()
    return LanguageModel(langs, words, grams)


def _identify(texts: pa.Array, model, state: dict) -> pa.Array:
    if "scorer" not in state:
        state["scorer"] = Scorer(model.value)
    found = [state["scorer"].score(t.as_py()) for t in texts]
    return pa.StructArray.from_arrays(
        [pa.array([lang for lang, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
        names=["lang_pred", "score"])


def language_of(df: DataFrame, model: LanguageModel, text: Column) -> Column:
    """Struct (``lang_pred``, ``score``) of whole texts; only the text is looked at.

    ``und`` with score 0 if the text is null or has no letter, or if the model knows no language.
    """
    shared, state = df.sparkSession.sparkContext.broadcast(model), {}

    def identify(texts: pa.Array) -> pa.Array:
        return _identify(texts, shared, state)

    # Declared nondeterministic, so that a filter on it does not run it once more.
    return F.arrow_udf(identify, RESULT).asNondeterministic()(text.cast("string"))


def identify_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``df``: ``id``, ``lang_pred``, ``score``.

    Null and repeated ids are rows like any other. A null or empty text, and one without a letter, is ``und`` with score 0. Texts
    are read whole, however long; languages of equal score tie to the first in alphabetical order. An empty table gives no row, and
    other columns do not matter.
    """
    found = language_of(df, model, F.col(f"`{text_col}`")).alias("found")
    return df.select(F.col(f"`{id_col}`").alias("id"), found).select("id", "found.lang_pred", "found.score")


def drop_unidentified(df: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose language is known with a score of at least ``least``; the columns stay as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    found = df.select(row, language_of(df, model, F.col(f"`{text_col}`")).alias("found"))
    return found.where((F.col("found.lang_pred") != NO_LANGUAGE) & (F.col("found.score") >= least)).select("row.*")
