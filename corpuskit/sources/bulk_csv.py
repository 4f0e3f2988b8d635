"""Bulk CSV with newlines inside quotes, in two escape dialects, plain or compressed."""

from __future__ import annotations

import warnings
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpuskit.functions.columns import quoted
from corpuskit.sources.cut_csv import read_well_quoted

ESCAPE = {"doubled": '"', "backslash": "\\"}
CORRUPT = "_corrupt_record"
# A field no file holds, for which a record is read a second time.
END_FIELD = "\x1e_end_of_record_\x1e"


def csv_options(dialect: str, null_value: str | None = None) -> dict[str, str]:
    options = {"quote": '"', "escape": ESCAPE[dialect], "multiLine": "true"}
    if null_value is not None:
        options["nullValue"] = null_value
    return options


def string_schema(names: list[str]) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


def read_bulk_csv(
    spark: SparkSession,
    path: str,
    dialect: str = "doubled",
    header: bool = True,
    schema: StructType | None = None,
    mode: str = "PERMISSIVE",
    null_value: str | None = None,
) -> DataFrame:
    """All columns as strings; compression follows the file extension.

    A file is one task, because a record may span lines and only reading from the start tells where it ends.
    Land large exports as several files. A single bzip2 file, whose decompression takes most of the time, is read by
    many tasks if it is larger than one task's share and well quoted.
    """
    reader = spark.read.options(**csv_options(dialect, null_value)).option("header", header).option("mode", mode)
    if schema is not None:
        reader = reader.schema(schema)
    whole = reader.csv(path)
    if dialect == "doubled" and header and schema is None and mode == "PERMISSIVE" and (file := _large_bz2(spark, whole)):
        options = {k: v for k, v in csv_options(dialect, null_value).items() if k != "multiLine"}
        cut = read_well_quoted(spark, file, whole.schema, options)
        return whole if cut is None else cut
    return whole


def _large_bz2(spark: SparkSession, rows: DataFrame) -> str | None:
    """The only file of ``rows``, if it is a bzip2 one of more bytes than a task is to read."""
    found = rows.inputFiles()
    if len(found) != 1 or not found[0].endswith(".bz2"):
        return None
    file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(found[0]))
    length = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(file).getLen()
    share = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return file.toString() if length > share else None


def split_bad_records(
    spark: SparkSession,
    path: str,
    schema: StructType,
    policy: str = "strict",
    dialect: str = "doubled",
    header: bool = True,
    null_value: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Well-formed records and malformed ones, the latter as ``_corrupt_record`` text.

    ``strict`` takes records with too few or too many fields as malformed. ``pandas``
    pads short records and takes only long ones as malformed, whatever their surplus fields
    hold. To skip bad records use the first frame; `read_checked_csv` warns or stops.
    Each use of either frame parses the files again.
    """
    if policy not in ("strict", "pandas"):
        raise ValueError(f"unknown policy: {policy}")
    rows = (
        spark.read.options(**csv_options(dialect, null_value))
        .option("header", header)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", "true")
        .schema(StructType([*schema.fields, *string_schema([CORRUPT]).fields]))
        .csv(path)
    )
    # The reader refuses queries that touch nothing but the corrupt text, such as a count
    # of either side; an empty piece of a data column keeps them valid.
    odd = F.concat_ws("", F.substring(F.col(quoted(schema.names[0])), 1, 0), CORRUPT) != ""
    text = [F.col(quoted(name)) for name in schema.names]
    sound, uneven = rows.where(~odd).select(*text), rows.where(odd).select(*text, CORRUPT)
    if policy == "strict":
        return sound, uneven
    # With one more field at its end a short record has that field in a declared column, a long one has not.
    options = {k: v for k, v in csv_options(dialect, null_value).items() if k != "multiLine"}
    again = F.from_csv(F.concat(CORRUPT, F.lit(f",{END_FIELD}")), ", ".join(f"{quoted(n)} string" for n in schema.names), options)
    parsed = uneven.withColumn("_again", again)
    values = [F.col("_again").getField(name) for name in schema.names]
    short = reduce(or_, [F.coalesce(v == END_FIELD, F.lit(False)) for v in values])
    padded = parsed.where(short).select(*[F.nullif(v, F.lit(END_FIELD)).alias(n) for v, n in zip(values, schema.names)])
    return sound.unionByName(padded), parsed.where(~short).select(*text, CORRUPT)


def read_checked_csv(
    spark: SparkSession, path: str, schema: StructType, on_bad: str = "skip", policy: str = "strict", **how
) -> DataFrame:
    """The well-formed records. Bad ones are left out (``skip``), told of (``warn``) or refused (``fail``).

    The last two read the files once more, to count the bad records.
    """
    if on_bad not in ("skip", "warn", "fail"):
        raise ValueError(f"unknown answer to bad records: {on_bad}")
    good, bad = split_bad_records(spark, path, schema, policy, **how)
    if on_bad != "skip" and (n := bad.count()):
        if on_bad == "fail":
            raise ValueError(f"{n} malformed records in {path}")
        warnings.warn(f"{n} malformed records in {path} are left out", stacklevel=2)
    return good
