"""Conversations and clips as training material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.sample import is_sampled

# What a chat shows while an answer is being typed.
PLACEHOLDERS = ["", "...", "…", "typing...", "typing…"]


def is_placeholder(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(PLACEHOLDERS), F.lit(True))


def dialogue_samples(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One sample per conversation: its number of messages and their lines ``role: text`` in order.

    Placeholders and messages without text are left out, and so are conversations without any other.
    """
    told = messages.where(~is_placeholder(F.col(text)))
    line = F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "), F.col(text))
    lines = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), line.alias("line"))))
    return told.groupBy(conversation).agg(
        F.count(F.lit(1)).alias("messages"), F.concat_ws("\n", F.transform(lines, lambda m: m["line"])).alias("sample"))


def select_clips(
    cues: DataFrame, least_s: float = 3, most_s: float = 10, speaker: str = "file_id", fewest: int = 200, most: int = 300
) -> DataFrame:
    """Per speaker: clips of ``least_s`` to ``most_s`` seconds, their length, and whether their number is as wanted."""
    millis = F.col("end_ms") - F.col("start_ms")
    return cues.where(millis.between(least_s * 1000, most_s * 1000)).groupBy(speaker).agg(
        F.count(F.lit(1)).alias("clips"), F.sum(millis).alias("millis"), F.count(F.lit(1)).between(fewest, most).alias("enough"))


def train_validation_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: ``validation`` for about ``share`` of the keys, by hash, else ``train``. A key is never in both."""
    return df.withColumn("split", F.when(is_sampled(F.col(key), 100 * share, seed), "validation").otherwise("train"))


def route_by_language(df: DataFrame, path: str, lang: str = "lang") -> None:
    """Rows laid out by language, a folder each; a language with most rows gets several files."""
    df.hint("rebalance", lang).write.mode("overwrite").partitionBy(lang).option("compression", "zstd").parquet(path)
