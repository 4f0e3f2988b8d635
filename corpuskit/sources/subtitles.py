"""Subtitle files to cue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: first two lines of a cue.
CUE_HEAD = r"^\s*(\d+)\s*\n(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)[^\n]*"


def _millis(block: Column, first_group: int) -> Column:
    h, m, s, ms = [F.regexp_extract(block, CUE_HEAD, first_group + i).try_cast("long") for i in range(4)]
    return ((h * 60 + m) * 60 + s) * 1000 + ms


def decode_subtitle(content: Column) -> Column:
    """UTF-8, or Latin-1 for a file that is not valid UTF-8; no BOM, and LF for CRLF. Other carriage returns stay."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    text = F.when(utf8, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.replace(F.regexp_replace(text, r"^\x{FEFF}", ""), F.lit("\r\n"), F.lit("\n"))


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """``file, position, block``: what blank lines separate; position counts blocks from 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split(decode_subtitle(F.col("content")), r"\n(?:[ \t]*\n)+")
    return files.select(F.col("path").alias("file"), F.posexplode(parts).alias("position", "block"))


def split_subtitles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cues (``file, position, cue_no, start_ms, end_ms, text``), and the blocks that are none (``file, position, block``).

    A file's cues have different positions, also where their numbers repeat. Blank blocks, as at the
    end of a file, are neither.
    """
    blocks, block = _blocks(spark, path), F.col("block")
    cues = blocks.where(block.rlike(CUE_HEAD)).select(
        "file",
        "position",
        F.regexp_extract(block, CUE_HEAD, 1).try_cast("int").alias("cue_no"),
        _millis(block, 2).alias("start_ms"),
        _millis(block, 6).alias("end_ms"),
        F.regexp_replace(F.regexp_replace(block, CUE_HEAD + r"\n?", ""), r"\n+$", "").alias("text"),
    )
    return cues, blocks.where(~block.rlike(CUE_HEAD) & block.rlike(r"\S"))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """The cues of `split_subtitles`."""
    return split_subtitles(spark, path)[0]
