"""Subtitle cues as a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import restore_breaks


def cue_counts(cues: DataFrame, file: str = "file_id") -> DataFrame:
    return cues.groupBy(file).agg(F.count(F.lit(1)).alias("cues"))


def place_of(cues: DataFrame) -> list[str]:
    """Columns that name a cue's place: its position in the file if that is known, else its number."""
    return ["file_id", "position" if "position" in cues.columns else "cue_no"]


def same_place(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in key])


def reassemble(cues: DataFrame, translated: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Cues with their translated text, broken into lines where the original had breaks, and ``answered``.

    ``key`` is the place of a cue, by default its position, for files repeat numbers or leave them out; without
    such a column it is the number. The whole place is the join key, so a long file spreads over many tasks. A cue without a translation keeps its text; ``translated``
    must have at most one row per place.
    """
    key = key or place_of(cues)
    texts = translated.select(*key, F.col("translated").alias("_translated"))
    answered = F.col("_translated").isNotNull()
    text = F.when(answered, restore_breaks(F.col("_translated"), cues["text"])).otherwise(cues["text"])
    return cues.join(texts, same_place(cues, texts, key), "left").select(
        *[text.alias("text") if c == "text" else cues[c] for c in cues.columns], answered.alias("answered"))
