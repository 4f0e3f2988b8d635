"""Subtitle files through a text model and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.text import flatten_lines, restore_breaks
from corpuskit.operators.cues import place_of, reassemble, same_place
from corpuskit.operators.inference import TextModel, map_text_batches
from corpuskit.sinks.subtitles import write_subtitles
from corpuskit.sources.subtitles import read_subtitles


def translate_cues(
    cues: DataFrame,
    model_factory: Callable[[], TextModel],
    batch_size: int = 32,
    done: DataFrame | None = None,
    parallelism: int | None = None,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Cues with translated text. Those in ``done``, from an interrupted run, are not asked again.

    A fresh run keeps each cue and its answer in one row and shuffles nothing; a resumed
    one puts old and new answers back by ``key``, the place of a cue (see `place_of`). ``done`` may not name a place twice.
    """
    key = key or place_of(cues)
    if done is None:
        asked = cues.withColumn("_flat", flatten_lines(F.col("text")))
        answered = map_text_batches(asked, "_flat", model_factory, batch_size, "_answer", parallelism)
        return answered.withColumn("text", restore_breaks(F.col("_answer"), F.col("text"))).select(*cues.columns)
    if not done.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("the earlier run names a cue twice")
    old = done.select(*key, "translated")
    flat = cues.select(*key, flatten_lines(F.col("text")).alias("_flat"))
    asked = flat.join(old, same_place(flat, old, key), "left_anti")
    answers = map_text_batches(asked, "_flat", model_factory, batch_size, parallelism=parallelism)
    return reassemble(cues, answers.select(*key, "translated").unionByName(old), key).drop("answered")


def run_translation(
    spark: SparkSession,
    src: str,
    out: str,
    model_factory: Callable[[], TextModel],
    batch_size: int = 32,
    parallelism: int | None = None,
) -> None:
    """Translates every subtitle file below ``src``; the results stand
    below ``out`` under the same relative paths, in a folder per task."""
    name = F.substring_index("file", src.rstrip("/") + "/", -1)
    cues = read_subtitles(spark, src).withColumn("file_id", name).drop("file")
    write_subtitles(translate_cues(cues, model_factory, batch_size, parallelism=parallelism), out, order="position")
