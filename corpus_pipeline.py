"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the one before it kept. All but the last return the columns of
``documents``; the last one returns the pieces of the packed sequences. Texts are read whole, however long. An empty table
passes through all stages and gives no piece; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import exact_dedup, jaccard, language_id, mixing, packing
from corpuskit.llm.queries import table, vocabulary
from corpuskit.session import materialise, temporary_copies


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter, and those whose language is not the likelier half of the belief.

    Null and empty texts go. Null labels teach nothing; a table without labels knows no language, so nothing of it stays.
    Repeated rows are judged alike, languages that tie go by the alphabet.
    """
    return language_id.drop_unidentified(docs, language_id.fit_languages(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the one of smallest id stays.

    Null ids come last, a null text equals an empty one, and of repeated rows one stays.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles the one of smallest id stays.

    Null ids come last; texts without words link with nothing and stay. Rows with the same id and text stay or go together; of
    different texts with the smallest id the one of smallest digest stays.
    """
    return jaccard.drop_near_copies(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings all documents into the order in which every source keeps its share of the text throughout.

    A null source is one of its own, a null text an empty one. Within a source rows go by id, null last, then by length and hash of
    the text, so repeated rows follow each other.
    """
    return mixing.in_mixed_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in the packed sequences, which are numbered in the order of the mix.

    No table keeps an order, so the places in the mix, which depend on the documents alone, are worked out again.
    Null and empty texts are pieces of one token; equal pieces are handed out in the order of the mix.
    """
    mixed = mixing.mix_sources(docs, carry=["doc_id", "text"]).select("row.*", "slot", "before")
    packed = packing.pack(mixed, vocabulary(), keep={"ids_crc32": F.crc32("ids")}, order=["slot", "before"])
    return packed.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("identify_language", identify_language),
    ("drop_exact_copies", drop_exact_copies),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# A fitted model and a search for the fewest sequences have no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What each stage kept is written to the shared folder for the next one."""
    docs = table(spark, sf_dir, "documents")
    with temporary_copies(spark) as kept:
        for name, stage in STAGES:
            with temporary_copies(spark) as result:
                docs = materialise(stage(spark, docs, sf_dir), name)
                result.append(docs)
        kept.append(docs)
    return docs
