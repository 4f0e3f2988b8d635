"""Cue rows to subtitle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.sinks.text_files import write_text_files


def _clock(ms: Column) -> Column:
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000,
    )


def cue_block(cue_no: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    """A cue as subtitle text, with one of the two newlines that end it.

    A blank line would end the cue early, so blank lines inside the text are left out.
    """
    lines = F.regexp_replace(text, r"\n(?:[ \t]*\n)+", "\n")
    return F.format_string("%s\n%s --> %s\n%s\n", cue_no, _clock(start_ms), _clock(end_ms), lines)


def write_subtitles(
    cues: DataFrame, path: str, line_end: str = "\n", order: str = "cue_no", cues_per_part: int | None = None
) -> None:
    """One file ``<file_id>.srt`` per ``file_id``, UTF-8, cues in the given order; a cue without number gets its place, if that is known.

    Rows stream to the writer one cue at a time, so no file has to fit in memory, and a task writes all files it is
    given. With ``cues_per_part`` a longer file has several parts, ``<file_id>.<part>.srt``, which make up the whole in the order of their names.
    """
    number = F.coalesce("cue_no", F.col(order) + 1) if order != "cue_no" else F.col("cue_no")
    block = F.concat(cue_block(number, F.col("start_ms"), F.col("end_ms"), F.col("text")), F.lit("\n"))
    if line_end != "\n":
        block = F.replace(block, F.lit("\n"), F.lit(line_end))
    name = F.regexp_replace(F.col("file_id").cast("string"), r"\.srt$", "")
    if cues_per_part:
        name = F.format_string("%s.%06d", name, F.floor(F.col(order) / cues_per_part))
    parts = cues.select(name.alias("name"), F.col(order).alias("_order"), block.alias("value"))
    write_text_files(parts.repartition("name").sortWithinPartitions("name", "_order"), path, suffix=".srt")
