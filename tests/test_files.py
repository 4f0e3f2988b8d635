"""Files written to a fresh folder and read back."""

import bz2
import glob
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuskit.operators.profile import null_rates
from corpuskit.plans.etl import EtlOptions, run_etl
from corpuskit.sinks import tables
from corpuskit.sinks.subtitles import write_subtitles
from corpuskit.sinks.text_files import write_text_files
from corpuskit.sources import files
from corpuskit.sources.bulk_csv import csv_options, read_bulk_csv, read_checked_csv, split_bad_records, string_schema
from corpuskit.sources.cut_csv import read_well_quoted
from corpuskit.sources.subtitles import read_subtitles, split_subtitles

NULL = "\\N"


@pytest.fixture
def small_splits(spark):
    """Cuts files of a few kilobytes into many splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def nasty_rows(n, seed=5):
    """Texts full of quotes, separators, line ends and escapes; some longer than a split."""
    rng = random.Random(seed)
    pieces = ['"', '""', ",", "\n", "\r\n", "é", "word ", "\\x", "\n\n", "'", "; "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 3, 40, 4000 if i % 97 == 0 else 20])))
        rows.append((str(i), rng.choice([None, "", text, text]), text + "end"))
    return rows


@pytest.mark.parametrize("dialect", ["doubled", "backslash"])
@pytest.mark.parametrize("compression", ["none", "bzip2"])
def test_reader_equals_rows_written(spark, folder, dialect, compression):
    rows = spark.createDataFrame(nasty_rows(600), "id string, a string, b string").coalesce(1)
    tables.write_csv(rows, folder + "/csv", dialect, NULL, compression)
    got = read_bulk_csv(spark, folder + "/csv", dialect, null_value=NULL)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_crlf_and_no_last_newline(spark, folder):
    path = folder + "/x.csv"
    body = "id,a\r\n" + "".join(f'{i},"l1\r\nl2 ""q"" {"z" * 50}"\r\n' for i in range(300)) + "300,last"
    with open(path, "w", newline="") as f:
        f.write(body)
    got = {r.id: r.a for r in read_bulk_csv(spark, path).collect()}
    assert len(got) == 301 and got["300"] == "last"
    assert got["7"] == f'l1\nl2 "q" {"z" * 50}'  # where records end in CRLF, the reader takes it for a newline in fields, too


def test_stray_quotes_and_blank_first_lines_lose_no_row(spark, folder):
    with open(folder + "/q.csv", "w") as f:
        f.write('id,t\n1,5" pipe\n2,plain\n3,6" pipe\n4,end\n')
    with open(folder + "/b.csv", "w") as f:
        f.write("\nid,t\n1,x\n")
    run_etl(spark, folder + "/q.csv", folder + "/out")
    assert sorted(map(tuple, spark.read.parquet(folder + "/out").collect())) == [("1", '5" pipe'), ("2", "plain"), ("3", '6" pipe'), ("4", "end")]
    assert [tuple(r) for r in read_bulk_csv(spark, folder + "/b.csv").collect()] == [("1", "x")]


def test_header_names_of_any_kind(spark, folder):
    with open(folder + "/h.csv", "w") as f:
        f.write('first name,a.b,"c`d"\n1,2,\n')
    df = read_bulk_csv(spark, folder + "/h.csv")
    assert df.columns == ["first name", "a.b", "c`d"] and df.collect() == [("1", "2", None)]
    rates = null_rates(read_bulk_csv(spark, folder + "/h.csv")).collect()
    assert [tuple(r) for r in rates] == [("c`d", 100.0), ("a.b", 0.0), ("first name", 0.0)]
    good, _ = split_bad_records(spark, folder + "/h.csv", string_schema(df.columns))
    assert good.count() == 1


def test_an_empty_file(spark, folder):
    with open(folder + "/e.csv", "w") as f:
        f.write("id,a\n")
    assert read_bulk_csv(spark, folder + "/e.csv").count() == 0


def test_null_and_empty_are_told_apart(spark, folder):
    path = folder + "/n.csv"
    with open(path, "w") as f:
        f.write('a,b\n\\N,""\n,x\n')
    assert [tuple(r) for r in read_bulk_csv(spark, path).collect()] == [("\\N", None), (None, "x")]
    assert [tuple(r) for r in read_bulk_csv(spark, path, null_value=NULL).collect()] == [(None, ""), (None, "x")]


def test_bz2_needs_no_unzip(spark, folder):
    with bz2.open(folder + "/x.csv.bz2", "wt") as f:
        f.write('id,t\n1,"two\nlines"\n')
    assert read_bulk_csv(spark, folder).collect() == [("1", "two\nlines")]


def test_bad_record_policies(spark, folder):
    path = folder + "/bad.csv"
    with open(path, "w") as f:
        f.write('id,a,b\n1,x,"y\nz"\n2,short\n3,x,y,long\n4,x,y,very,long\n5,x,y\n6,x,y,,lost\n7,x,y,\n8,"open\nx",,,\n9\n')
    schema = string_schema(["id", "a", "b"])
    good, bad = split_bad_records(spark, path, schema, "strict")
    assert [r.id for r in good.collect()] == ["1", "5"] and sorted(r.id for r in bad.collect()) == ["2", "3", "4", "6", "7", "8", "9"]
    good, bad = split_bad_records(spark, path, schema, "pandas")
    assert sorted(tuple(r) for r in good.collect()) == [("1", "x", "y\nz"), ("2", "short", None), ("5", "x", "y"), ("9", None, None)]
    assert good.count() == 4 and bad.count() == 5
    assert {r.id: r["_corrupt_record"] for r in bad.collect()} == {
        "3": "3,x,y,long", "4": "4,x,y,very,long", "6": "6,x,y,,lost", "7": "7,x,y,", "8": '8,"open\nx",,,'}
    assert read_checked_csv(spark, path, schema).count() == 2
    with pytest.warns(UserWarning, match="5 malformed"):
        assert read_checked_csv(spark, path, schema, "warn", "pandas").count() == 4
    with pytest.raises(ValueError, match="7 malformed"):
        read_checked_csv(spark, path, schema, "fail")
    with pytest.raises(ValueError):
        split_bad_records(spark, path, schema, "lenient")


def test_fail_fast_and_drop(spark, folder):
    path = folder + "/bad.csv"
    with open(path, "w") as f:
        f.write("id,a\n1,x\n2,y,long\n")
    schema = string_schema(["id", "a"])
    with pytest.raises(Exception):
        read_bulk_csv(spark, path, schema=schema, mode="FAILFAST").collect()
    assert read_bulk_csv(spark, path, schema=schema, mode="DROPMALFORMED").collect() == [("1", "x")]
    assert read_bulk_csv(spark, path, schema=schema, mode="DROPMALFORMED").select("id").collect() == [("1",)]
    assert read_bulk_csv(spark, path, schema=schema, mode="DROPMALFORMED").count() == 1


def test_etl_compacts(spark, folder):
    rows = spark.createDataFrame(nasty_rows(400), "id string, a string, b string").repartition(5)
    tables.write_csv(rows, folder + "/csv", null_value=NULL)
    n = run_etl(spark, folder + "/csv", folder + "/out", EtlOptions(null_value=NULL, stage=folder + "/stage"))
    assert n == 1 and len(spark.read.parquet(folder + "/out").inputFiles()) == 1
    assert sorted(map(tuple, spark.read.parquet(folder + "/out").collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("target", [1_000, 10_000, 10**9])
def test_compact_hits_planned_number(spark, folder, target):
    spark.range(20_000).repartition(6).write.parquet(folder + "/in")
    n = tables.compact(spark, folder + "/in", folder + "/out", target)
    size = files.dataset_bytes(spark, folder + "/in").first()["bytes"]
    assert n == max(1, -(-size // target))
    assert len(spark.read.parquet(folder + "/out").inputFiles()) == n
    assert spark.read.parquet(folder + "/out").distinct().count() == 20_000


def test_raw_head_numbers_lines_across_splits(spark, folder, small_splits):
    with open(folder + "/a.txt", "w") as f:
        f.write("\n" * 9_000 + "first\n\nsecond\n")
    with open(folder + "/b.txt", "w") as f:
        f.write("third\nfourth\n")
    got = files.raw_head(spark, folder, 3).collect()
    assert [(r.file[-5:], r.line_no, r.line) for r in got] == [("a.txt", 9001, "first"), ("a.txt", 9003, "second"), ("b.txt", 1, "third")]


def test_documents_append_and_replace(spark, folder):
    def docs(rows):
        return spark.createDataFrame(rows, "collection string, year int, number string, metadata string")

    tables.write_documents(docs([("ny", 2001, "N1", "a"), ("ny", 2002, "N2", "b")]), folder + "/s")
    tables.write_documents(docs([("NY", 2001, "N3", "c")]), folder + "/s")
    assert spark.read.parquet(folder + "/s").count() == 3
    tables.write_documents(docs([("NY", 2001, "N4", "d")]), folder + "/s", replace=True)
    assert sorted(r.number for r in spark.read.parquet(folder + "/s").collect()) == ["N2", "N4"]


def test_subtitle_encodings(spark, folder):
    text = "1\n00:00:01,500 --> 00:00:02,000\nCafé\nnoir\n\n2\n01:02:03,004 --> 01:02:04,000\nadiós\n\n"
    variants = {
        "utf8.srt": text.encode(), "bom.srt": b"\xef\xbb\xbf" + text.encode(),
        "latin.srt": text.encode("latin-1"), "crlf.srt": text.replace("\n", "\r\n").encode(),
        "blank.srt": text.replace("\n\n", "\n \n\n").encode(), "tight.srt": text.strip().encode(),
    }
    for name, content in variants.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)
    rows = read_subtitles(spark, folder).collect()
    for name in variants:
        cues = sorted(tuple(r)[1:] for r in rows if r.file.endswith(name))
        assert cues == [(0, 1, 1500, 2000, "Café\nnoir"), (1, 2, 3723004, 3724000, "adiós")], name


def test_subtitle_blocks_that_are_no_cues(spark, folder):
    whole = "no number\n\n1\n00:00:01,000 --> 00:00:02,000\na\rb\n\n00:00:01,000 --> 00:00:02,000\nc\n\n1\n00:00:03,000 --> 00:00:04,000\nd\n\n"
    with open(f"{folder}/odd.srt", "wb") as f:
        f.write(whole.encode())
    cues, rejected = split_subtitles(spark, folder)
    assert [(r.position, r.cue_no, r.text) for r in cues.orderBy("position").collect()] == [(1, 1, "a\rb"), (3, 1, "d")]
    assert sorted(r.position for r in rejected.collect()) == [0, 2]


def test_subtitle_files_are_whole_and_ordered(spark, folder):
    cues = spark.range(900).select(
        (F.col("id") % 7).alias("file_id"), (F.floor(F.col("id") / 7) + 1).alias("cue_no"),
        (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 999).alias("end_ms"),
        F.concat(F.lit("line "), F.col("id")).alias("text")).repartition(5)
    write_subtitles(cues, folder + "/srt")
    parts = spark.read.text(folder + "/srt", wholetext=True)
    assert parts.count() == 7
    first = parts.where(F.col("_metadata.file_name") == "0.srt").first().value
    numbers = [int(block.split("\n")[0]) for block in first.strip().split("\n\n")]
    assert numbers == list(range(1, len(numbers) + 1))
    assert first.startswith("1\n00:00:00,000 --> 00:00:00,999\nline 0\n\n2\n")
    assert read_subtitles(spark, folder + "/srt").count() == 900


def test_text_files_have_their_names_and_replace_earlier_ones(spark, folder):
    rows = [("a/b", "x"), ("a/b", "y"), ("../../etc", "z"), ("é ü", ""), (None, "n"), ("..", "d")]
    df = spark.createDataFrame(rows, "name string, value string").coalesce(1)
    for _ in range(2):
        write_text_files(df, folder + "/out", suffix=".txt")
    found = {p.relative_to(folder + "/out").as_posix().partition("/")[2]: p.read_text() for p in Path(folder, "out").rglob("*.txt")}
    assert found == {"a/b.txt": "xy", "%2E%2E/%2E%2E/etc.txt": "z", "%C3%A9 %C3%BC.txt": "", "null.txt": "n", "%2E%2E.txt": "d"}
    write_text_files(df.limit(1), folder + "/out", mode="append")
    assert len(list(Path(folder, "out").iterdir())) == 2


def test_failed_tasks_leave_no_text_files(spark, folder):
    df = spark.range(20, numPartitions=4).select(
        F.col("id").cast("string").alias("name"), F.when(F.col("id") == 19, F.raise_error(F.lit("stop"))).otherwise("text").alias("value"))
    with pytest.raises(Exception, match="stop"):
        write_text_files(df, folder + "/out")
    assert not list(Path(folder).glob("out/task=*"))


@pytest.fixture
def small_shares(spark):
    """Tasks read some kilobytes each, so that a small file counts as a large one."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, ["8k", "1k"]):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def whole_file(spark, path):
    return spark.read.options(**csv_options("doubled", "\\N")).option("header", True).csv(path)


def land_bz2(folder, text):
    """A file of many small blocks."""
    with open(f"{folder}/export.csv.bz2", "wb") as f:
        f.write(bz2.compress(text.encode(), 1))
    return f"{folder}/export.csv.bz2"


def test_one_large_bz2_file_is_written_and_read_by_many_tasks(spark, folder, small_shares):
    texts = ['a "quoted" word, and\n\n"more', "plain", "", None, '1,2,3\n4,"5",6\n', '"', "\u00e9t\u00e9\nN", "\\N x", " led", '""\n""']
    rng = random.Random(7)
    rows = [(i, rng.choice(texts), "".join(rng.choices("abc,\"\n xyz", k=rng.randint(0, 400)))) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, short string, long string").repartition(5, "id")
    path = folder + "/one"
    tables.write_one_csv(df, path)
    assert len(glob.glob(path + "/part-*")) == 1
    got = read_bulk_csv(spark, path, null_value="\\N")
    assert got.rdd.getNumPartitions() > 1
    assert rows_of(got) == rows_of(whole_file(spark, path)) == sorted([(str(i), a, b) for i, a, b in rows], key=repr)


def test_one_bz2_file_without_rows_has_its_header(spark, folder):
    tables.write_one_csv(spark.createDataFrame([], "id long, text string"), folder + "/one")
    got = read_bulk_csv(spark, folder + "/one", null_value="\\N")
    assert got.columns == ["id", "text"] and got.count() == 0


def test_pieces_that_were_guessed_wrong_are_scanned_again(spark, folder, small_shares):
    # Records have fewer fields than their header; lines of their texts look like full ones.
    text = "id,text\n" + "".join('"%d\n%s"\n' % (i, "\n".join(f"{i * j % 997},{j}" for j in range(3000))) for i in range(60))
    path = land_bz2(folder, text)
    got = read_bulk_csv(spark, path, null_value="\\N")
    assert got.rdd.getNumPartitions() > 1
    assert rows_of(got) == rows_of(whole_file(spark, path))


@pytest.mark.parametrize("odd", ['7,5" wide,x', '7,"a"b,x', "7,a\rb,x", "", "  ,b,x", '7,"a" ,x', '7,"open,x'])
def test_a_bz2_file_with_an_odd_record_is_read_whole(spark, folder, small_shares, odd):
    lines = [f'{i},"a\n{i * 7919 % 10007}",{i * 104729 % 15485863}' for i in range(4000)]
    lines.insert(2000, odd)
    path = land_bz2(folder, "id,a,b\n" + "\n".join(lines) + "\n")
    assert read_well_quoted(spark, path, string_schema(["id", "a", "b"]), {}) is None
    assert rows_of(read_bulk_csv(spark, path, null_value="\\N")) == rows_of(whole_file(spark, path))
