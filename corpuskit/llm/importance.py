"""Importance resampling towards a target collection, over hashed word n-grams.

A text becomes words in bytes: one table of 256 bytes lower-cases A-Z and blanks separators, and
``bytes.split`` does the rest. The bucket of an n-gram is its CRC-32; that of a longer one goes on from the
CRC-32 of its beginning, so each word of a text is hashed once for every length. Counters fold the n-grams of
a document before they are looked up. How much likelier a bucket is in the target than in the corpus is its
gain; a document weighs the sum over its features, and Gumbel noise from its id turns the highest scores into a
draw without replacement.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ordered import row_numbers
from corpuskit.session import materialise

# Fixed values of the contract.
LONGEST = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

# Words are runs of ASCII letters, digits and all bytes above ASCII; A-Z become a-z, all else a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MEMO_WORDS = 500_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Hasher:
    """Features of a text as counts by CRC-32; remembers the hashes of words while a task runs."""

    def __init__(self, longest: int):
        self.longest = longest
        self.memo: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            found = self.memo[word] = crc32(word)
        return found

    def features(self, words: list[bytes]) -> Counter:
        """How often each n-gram occurs, by its CRC-32, for n from 1 to ``longest``."""
        out: Counter = Counter()
        for word, n in Counter(words).items():
            out[self._hash(word)] += n
        if self.longest > 1:
            spaced = [b" " + w for w in words]
            seeds = [self._hash(w) for w in words]
            for n in range(2, self.longest + 1):
                # The hash of n words goes on from that of the first n - 1.
                seeds = [crc32(follows, seed) for seed, follows in zip(seeds, spaced[n - 1 :])]
                out.update(seeds)
        return out


def _count(batches, longest: int, buckets: int):
    """Rows (bucket, n) of a task: at most one per bucket."""
    hasher, total = Hasher(longest), np.zeros(buckets, np.int64)
    for batch in batches:
        for text in batch.column(0):
            found = hasher.features(words_of(text.as_py()))
            if found:
                at = np.fromiter(found.keys(), np.int64, len(found)) % buckets
                np.add.at(total, at, np.fromiter(found.values(), np.int64, len(found)))
    some = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])


def bucket_counts(df: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """Features per bucket over all whole texts of ``df``; the list has ``buckets`` numbers, whatever the size of the table."""
    texts = df.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    found = texts.mapInArrow(partial(_count, longest=longest, buckets=buckets), "bucket bigint, n bigint")
    out = [0] * buckets
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(q / p)) per bucket, with every bucket counted once more than it occurs."""
    buckets, all_corpus, all_target = len(corpus), sum(corpus), sum(target)
    out = []
    for s, t in zip(corpus, target):
        ratio = (float(t + 1) * float(all_corpus + buckets)) / (float(s + 1) * float(all_target + buckets))
        out.append(math.floor(1000 * math.log(ratio)))
    return out


def noise(id_text: str, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{id_text}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(batches, gains, longest: int, buckets: int, seed: int):
    hasher, table = Hasher(longest), None
    for batch in batches:
        if table is None:
            table = gains.value
        out = {"n_words": [], "n_features": [], "weight": [], "score": []}
        for id_text, text in zip(batch.column(1).to_pylist(), batch.column(2)):
            words = words_of(text.as_py())
            found = hasher.features(words)
            weight = sum(table[h % buckets] * n for h, n in found.items())
            out["n_words"].append(len(words))
            out["n_features"].append(sum(found.values()))
            out["weight"].append(weight)
            out["score"].append(weight + noise(id_text, seed))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64()) for v in out.values()]], names=["id", *out])


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """A row per row of ``df``: ``id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank``.

    Of the N texts with ``least_words`` words the floor(percent N / 100) highest scores are drawn and ranked from
    1; all others have a null rank. Ties go to the smaller id, null ids last, then to either of equal rows. A null or empty
    text has no word, weight 0 and is not drawn; a null id draws its noise as an empty text. Repeated ids share their noise and are rows
    of their own. Texts are read whole, however long. An empty ``df`` gives no row; with an empty ``target`` the
    rarer buckets of the corpus gain. Other columns of either table do not matter.

    Only the gains, ``buckets`` numbers, are broadcast. Ranks are running counts over even ranges of the scores,
    so no task sees all of them.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    corpus, wanted = bucket_counts(df, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets)
    gains = spark.sparkContext.broadcast(bucket_gains(corpus, wanted))
    own = F.col(f"`{id_col}`")
    rows = df.select(
        own.alias("id"), F.coalesce(own.cast("string"), F.lit("")).alias("id_text"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    work = partial(_score, gains=gains, longest=longest, buckets=buckets, seed=seed)
    scored = materialise(
        rows.mapInArrow(work, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint"), "scored")
    gains.destroy()
    fits = F.col("n_words") >= least_words
    drawn = scored.where(fits).count() * percent // 100
    order = [fits.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("_row").asc()]
    numbered = row_numbers(scored.withColumn("_row", F.monotonically_increasing_id()), [], order, "_place")
    # Texts that fit come first, so their places are their ranks.
    return numbered.select(
        "id", "n_words", "n_features", "weight", "score", F.when(F.col("_place") <= drawn, F.col("_place")).alias("rank"))
