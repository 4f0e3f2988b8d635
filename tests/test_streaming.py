"""Streams stop and resume; what they store equals the batch result."""

import glob
import json
import time

import pytest
from pyspark.sql import functions as F

from corpuskit.operators.requests import endpoint_health
from corpuskit.streaming.dedupe import dedupe_stream
from corpuskit.streaming.health import health_stream, read_health
from corpuskit.streaming.ingest import ingest_stream
from corpuskit.streaming.state import batch_path, millis_of

LOG = "req_id long, ts timestamp, endpoint_id long, status int"


def land(folder, name, numbers, collection="NY"):
    items = [{"collection": collection, "number": n, "date": "2001"} for n in numbers]
    with open(f"{folder}/{name}.json", "w") as f:
        json.dump({"rulings": items, "total": len(items)}, f, indent=2)


def stored(spark, out):
    return sorted(r.number for r in spark.read.parquet(out).collect())


def test_ingest_resumes_by_file_and_key(spark, folder):
    src, out, progress = folder, folder + "-out", folder + "-progress"
    land(src, "p1", ["N1", "N2", "N2"])
    ingest_stream(spark, src, out, progress).awaitTermination()
    assert stored(spark, out) == ["N1", "N2"]
    land(src, "p0", ["N2", "N3"])
    ingest_stream(spark, src, out, progress).awaitTermination()
    assert stored(spark, out) == ["N1", "N2", "N3"]
    ingest_stream(spark, src, out, progress).awaitTermination()
    assert stored(spark, out) == ["N1", "N2", "N3"]


def test_store_is_laid_out_by_collection_and_year(spark, folder):
    land(folder, "p1", ["N1"], "ny")
    land(folder, "p2", ["H1"], "hq")
    ingest_stream(spark, folder, folder + "-out", folder + "-progress").awaitTermination()
    files = spark.read.parquet(folder + "-out").inputFiles()
    assert any("/collection=NY/year=2001/" in f for f in files) and any("/collection=HQ/" in f for f in files)


def test_collection_may_come_from_the_caller(spark, folder):
    land(folder, "p1", ["N1"], None)
    run = folder + "-progress"
    ingest_stream(spark, folder, folder + "-out", run, collection=F.lit("ny")).awaitTermination()
    assert spark.read.parquet(folder + "-out").first()["collection"] == "NY"


def test_restart_reads_all_and_skips_stored(spark, folder):
    src, out, progress = folder, folder + "-out", folder + "-progress"
    land(src, "p1", ["N1"])
    ingest_stream(spark, src, out, progress).awaitTermination()
    land(src, "p2", ["N2"])
    query = ingest_stream(spark, src, out, progress, restart=True)
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2
    assert stored(spark, out) == ["N1", "N2"]


def test_small_batches_store_each_key_once(spark, folder):
    for i in range(4):
        land(folder, f"p{i}", [f"N{i}", "N0", f"N{i + 1}"])
    ingest_stream(spark, folder, folder + "-out", folder + "-progress", files_per_batch=1).awaitTermination()
    assert stored(spark, folder + "-out") == ["N0", "N1", "N2", "N3", "N4"]



def test_a_batch_reads_no_stored_batch(spark, folder):
    src, out, progress = folder, folder + "-out", folder + "-progress"
    land(src, "p1", ["N1", "N2"])
    ingest_stream(spark, src, out, progress).awaitTermination()
    for file in glob.glob(f"{batch_path(out, 'main', 0)}/**/*.parquet", recursive=True):
        with open(file, "wb") as f:
            f.write(b"not parquet")
    land(src, "p2", ["N2", "N3"])
    ingest_stream(spark, src, out, progress).awaitTermination()
    assert stored(spark, batch_path(out, "main", 1)) == ["N3"]


def land_repeated(folder, prefix, numbers, files=8):
    """Every number in every file, in another order; its first row is in the first file."""
    for i in range(files):
        land(folder, f"{prefix}{i}", numbers[i * 7 % len(numbers):] + numbers[:i * 7 % len(numbers)])


def test_first_row_of_a_batch_is_stored_also_under_other_shuffle_settings(spark, folder):
    src, out, progress = folder, folder + "-out", folder + "-progress"
    land_repeated(src, "p", [f"N{i}" for i in range(60)])
    ingest_stream(spark, src, out, progress).awaitTermination()
    land_repeated(src, "q", [f"N{i}" for i in range(30, 120)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        query = ingest_stream(spark, src, out, progress)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted((int(r.number[1:]), r.file.rsplit("/", 1)[1], r.idx) for r in spark.read.parquet(out).collect())
    assert got == [(i, "p0.json", i) for i in range(60)] + [(i, "q0.json", i - 30) for i in range(60, 120)]
    plan = query._jsq.explainInternal(False)
    between = plan[plan.index("StreamingDeduplicate"):plan.index("MapInArrow")]
    assert between.index("Sort") < between.index("Exchange") and between.count("Exchange") == 1


def test_a_small_batch_is_few_files_and_keeps_its_state_in_the_engine(spark, folder):
    for i in range(8):
        land(folder, f"p{i}", [f"N{i}{j}" for j in range(40)])
    query = ingest_stream(spark, folder, folder + "-out", folder + "-progress")
    query.awaitTermination()
    assert len(glob.glob(f"{batch_path(folder + '-out', 'main', 0)}/**/*.parquet", recursive=True)) == 1
    assert len(stored(spark, folder + "-out")) == 320
    assert [state["operatorName"] for state in query.recentProgress[0]["stateOperators"]] == ["dedupe"]


def test_ingest_leaves_the_settings_of_the_session(spark, folder):
    land(folder, "p1", ["N1"])
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.streaming.unsupportedOperationCheck"]
    before = [spark.conf.get(name) for name in names]
    ingest_stream(spark, folder, folder + "-out", folder + "-progress").awaitTermination()
    assert [spark.conf.get(name) for name in names] == before

@pytest.fixture
def log_files(spark, folder):
    """A request log in five files in time order; endpoint 0 has most of the requests."""
    log = spark.range(3_000).select(
        F.col("id").alias("req_id"), F.timestamp_seconds(F.col("id")).alias("ts"),
        F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.abs(F.hash("id")) % 9).cast("long").alias("endpoint_id"),
        F.expr("element_at(array(200, 503, null, 404, 429, 500), 1 + abs(hash(id, 7)) % 6)").alias("status"))
    for i in range(5):
        log.where(F.floor(F.col("req_id") / 600) == i).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in order of their modification time
    return log


def test_health_over_batches_equals_batch(spark, folder, log_files):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    query, run = health_stream(stream, "endpoint_id", ["ts", "req_id"], folder + "-state", folder + "-progress")
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 4
    got = read_health(stream, "endpoint_id", folder + "-state", run)
    expected = endpoint_health(log_files, "endpoint_id", ["ts", "req_id"])
    order = expected.columns
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, expected.collect()))
    assert spark.read.parquet(batch_path(folder + "-state", run, 0)).count() > 0


def test_health_goes_on_after_a_stop(spark, folder, log_files):
    part, state, progress = folder + "-part", folder + "-state", folder + "-progress"
    for low, high in [(0, 1_400), (1_400, 3_000)]:
        log_files.where((F.col("req_id") >= low) & (F.col("req_id") < high)).coalesce(1).write.mode("append").parquet(part)
        stream = spark.readStream.schema(LOG).parquet(part)
        query, run = health_stream(stream, "endpoint_id", ["ts", "req_id"], state, progress)
        query.awaitTermination()
    expected = endpoint_health(log_files, "endpoint_id", ["ts", "req_id"])
    got = read_health(stream, "endpoint_id", state, run).select(expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_dedupe_keeps_one_row_per_key(spark, folder, log_files):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(folder)
    out = folder + "-out"
    dedupe_stream(stream, ["endpoint_id"], "ts", "30 days").select("endpoint_id").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", folder + "-progress").trigger(availableNow=True).start().awaitTermination()
    got = [r.endpoint_id for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == {r[0] for r in log_files.select("endpoint_id").distinct().collect()}


def sightings(spark, folder, batches, horizon="10 seconds"):
    """Rows (key, at, late) of a stream of batches of (key, seconds), taken in order."""
    src, out = folder + "-in", folder + "-out"
    for rows in batches:
        df = spark.createDataFrame([(k, s, 2**53 + 1) for k, s in rows], "k string, s long, big long")
        df.select("k", F.timestamp_seconds("s").alias("at"), "big").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = spark.readStream.schema("k string, at timestamp, big long").option("maxFilesPerTrigger", 1).parquet(src)
    dedupe_stream(stream, ["k"], "at", horizon).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", folder + "-progress").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).select("k", F.unix_seconds("at").alias("s"), "late", "big").collect()
    assert all(r.big == 2**53 + 1 for r in got)
    return sorted(((r.k, r.s, r.late) for r in got), key=repr)


def test_late_first_sightings_come_out_marked(spark, folder):
    got = sightings(spark, folder, [[("a", 100), ("a", 101), ("b", 95)], [("c", 80), ("a", 99), ("d", 93), ("c", 70)], [("c", 81), (None, 50), (None, 102)]])
    assert got == sorted([("a", 100, False), ("b", 95, False), ("c", 70, True), ("d", 93, False), (None, 50, True)], key=repr)


def test_keys_are_forgotten_after_the_horizon(spark, folder):
    got = sightings(spark, folder, [[("a", 100)], [("a", 105), ("x", 106)], [("x", 130)], [("y", 131)], [("a", 130), ("x", 131)]])
    assert got == [("a", 100, False), ("a", 130, False), ("x", 106, False), ("y", 131, False)]


def test_intervals():
    assert millis_of("90 minutes") == 5_400_000 and millis_of("1 day 2 hours") == 93_600_000
    for odd in ("", "1 month", "day"):
        with pytest.raises(ValueError):
            millis_of(odd)
