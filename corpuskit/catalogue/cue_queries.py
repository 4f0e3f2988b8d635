"""Subtitle cues, their files, and batched text models over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalogue.views import table, view, with_views
from corpuskit.functions.text import flatten_lines
from corpuskit.functions.text import restore_breaks as broken
from corpuskit.operators import cues as ops
from corpuskit.operators.inference import glossary_model, map_text_batches
from corpuskit.plans import translate
from corpuskit.session import scratch_path
from corpuskit.sinks.subtitles import write_subtitles
from corpuskit.sinks.text_files import write_text_files
from corpuskit.sources.subtitles import read_subtitles, split_subtitles

# A stand-in for a translation model; it changes letters and keeps spaces.
GLOSSARY = {"the": "THE", "e": "é"}

ODD_CUES = """select conv_id as file_id, turn as position,
    case when turn % 4 = 0 then null when turn % 4 = 1 then 1 else turn end as cue_no,
    case when turn % 3 = 0 then null else 9007199254740993 + conv_id end as ref,
    case when (conv_id + turn) % 6 = 0 then null when length(text) > 40
      then concat(substring(text, 1, 20), chr(10), substring(text, 21)) else text end as text
    from conversations"""
# Cues, cues with BOM or carriage returns, blocks that are none; each with the blank line after it.
ODD_SUBTITLES = """select conv_id as file_id, turn, conv_id + turn as kind, case (conv_id + turn) % 4
    when 0 then concat(turn, chr(10), '00:00:01,000 --> 00:00:02,000', chr(10), 'text', chr(10))
    when 1 then concat('00:00:01,000 --> 00:00:02,000', chr(10), 'no number ', turn, chr(10))
    when 2 then concat(turn, chr(13), chr(10), '00:00:01,000 --> 00:00:02,000', chr(13), chr(10), 'a', chr(13), 'b', chr(10))
    else concat('no times ', turn, chr(10)) end as value from conversations"""


def cue_counts(spark, sf_dir):
    return ops.cue_counts(view(spark, sf_dir, "cues"))


def subtitle_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "subtitles")
    write_subtitles(view(spark, sf_dir, "cues"), path, line_end="\r\n")
    file_id = F.regexp_extract("file", r"/(\d+)\.srt$", 1).cast("bigint")
    return read_subtitles(spark, path).withColumn("file_id", file_id).drop("file", "position")


def text_batches(spark, sf_dir):
    return map_text_batches(view(spark, sf_dir, "cues"), "text", glossary_model(GLOSSARY)).select(
        "file_id", "cue_no", "translated")


def translate_cues(spark, sf_dir):
    return translate.translate_cues(view(spark, sf_dir, "cues"), glossary_model(GLOSSARY))


def translate_cues_resumed(spark, sf_dir):
    """The same with the cues of one length class already answered by an earlier run."""
    cues = view(spark, sf_dir, "cues")
    earlier = cues.where(F.length("text") > 500).select("file_id", "cue_no", flatten_lines(F.col("text")).alias("flat"))
    done = map_text_batches(earlier, "flat", glossary_model(GLOSSARY))
    return translate.translate_cues(cues, glossary_model(GLOSSARY), done=done, key=["file_id", "cue_no"])


def _odd_cues(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(ODD_CUES)


def translate_odd_cues(spark, sf_dir):
    """Numbers that repeat or are missing, texts that are null, and large integers beside them."""
    return translate.translate_cues(_odd_cues(spark, sf_dir), glossary_model(GLOSSARY))


def translate_odd_cues_resumed(spark, sf_dir):
    cues = _odd_cues(spark, sf_dir)
    earlier = cues.where("position % 3 = 1").select("file_id", "position", flatten_lines(F.col("text")).alias("flat"))
    return translate.translate_cues(cues, glossary_model(GLOSSARY), done=map_text_batches(earlier, "flat", glossary_model(GLOSSARY)))


def odd_subtitle_blocks(spark, sf_dir):
    """What is no cue, with its file and place: blocks without number, or without times."""
    path = scratch_path(spark, "odd_subtitles")
    rows = _given_subtitles(spark, sf_dir)
    lines = rows.select(F.col("file_id").cast("string").alias("name"), "turn", F.concat("value", F.lit("\n")).alias("value"))
    write_text_files(lines.repartition("name").sortWithinPartitions("name", "turn"), path, suffix=".srt")
    _, rejected = split_subtitles(spark, path)
    file_id = F.regexp_extract("file", r"/(\d+)\.srt$", 1).cast("bigint")
    return rejected.select(file_id.alias("file_id"), F.col("position").cast("bigint").alias("position"), "block")


def _given_subtitles(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(ODD_SUBTITLES)


def restore_breaks(spark, sf_dir):
    return view(spark, sf_dir, "cues").select(
        "file_id", "cue_no", broken(F.translate(flatten_lines(F.col("text")), "a", "A"), F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in [
    cue_counts, subtitle_roundtrip, text_batches, translate_cues, translate_cues_resumed, restore_breaks,
    translate_odd_cues, translate_odd_cues_resumed, odd_subtitle_blocks,
]}

_GLOSSED = "replace(replace({}, 'the', 'THE'), 'e', 'é')"
# The first N spaces become newlines, N being the newlines of the original.
_BROKEN = """concat(
    array_to_string(list_slice(string_split(flat, ' '), 1, breaks + 1), chr(10)),
    case when len(string_split(flat, ' ')) > breaks + 1 then ' ' else '' end,
    array_to_string(list_slice(string_split(flat, ' '), breaks + 2, len(string_split(flat, ' '))), ' '))"""
_BREAKS = "length(text) - length(replace(text, chr(10), '')) as breaks"
_TRANSLATED = with_views(f"""
    select file_id, cue_no, start_ms, end_ms, {_BROKEN} as text
    from (select *, {_GLOSSED.format("replace(text, chr(10), ' ')")} as flat, {_BREAKS} from cues)""", "cues")

_ODD_TRANSLATED = f"""
    select file_id, position, cue_no, ref, case when text is null then null else {_BROKEN} end as text
    from (select *, {_GLOSSED.format("replace(text, chr(10), ' ')")} as flat, {_BREAKS} from ({ODD_CUES}))"""

ORACLE = {
    "cue_counts": with_views("select file_id, count(*) as cues from cues group by file_id", "cues"),
    "subtitle_roundtrip": with_views(r"""
        select file_id, cast(cue_no as int) as cue_no, start_ms, end_ms,
          regexp_replace(text, '\n+', chr(10), 'g') as text from cues""", "cues"),
    "text_batches": with_views(f"select file_id, cue_no, {_GLOSSED.format('text')} as translated from cues", "cues"),
    "translate_cues": _TRANSLATED,
    "translate_cues_resumed": _TRANSLATED,
    "translate_odd_cues": _ODD_TRANSLATED,
    "translate_odd_cues_resumed": _ODD_TRANSLATED,
    "odd_subtitle_blocks": f"""
        select file_id, row_number() over (partition by file_id order by turn) - 1 as position, rtrim(value, chr(10)) as block
        from ({ODD_SUBTITLES}) qualify kind % 4 in (1, 3)""",
    "restore_breaks": with_views(f"""
        select file_id, cue_no, {_BROKEN} as text
        from (select *, replace(replace(text, 'a', 'A'), chr(10), ' ') as flat, {_BREAKS} from cues)""", "cues"),
}
