"""Physical plans: what is read, what is shuffled, what is pushed down."""

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import audit, ordered, profile, rulings, sample
from corpuskit.operators.inference import glossary_model
from corpuskit.plans.translate import translate_cues
from corpuskit.sources import files
from corpuskit.streaming.state import batch_path, open_store, read_store, write_batch

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning")


def test_audit_reads_the_text_column_only(documents):
    p = plan(audit.audit_counts(documents, ["text"]))
    assert "ReadSchema: struct<text:string>" in p
    assert p.count("Exchange") == 1 and "Exchange SinglePartition" in p  # one row of partial counts per task


@pytest.mark.parametrize("build", [
    lambda d: audit.longest_rows(d, "text", key="doc_id"),
    lambda d: audit.top_values(d, "source"),
    lambda d: audit.control_char_examples(d, "text", key="doc_id"),
    lambda d: files.head_rows(d, 5, "doc_id"),
    lambda d: sample.random_rows(d, "doc_id"),
], ids=["longest", "top_values", "control", "head", "random"])
def test_top_k_never_sorts_everything(documents, build):
    p = plan(build(documents))
    assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p


def test_top_values_counts_before_the_shuffle(documents):
    p = plan(audit.top_values(documents, "source"))
    assert "partial_count" in p and "ReadSchema: struct<source:string>" in p


def test_sample_is_a_filter(documents):
    assert "Exchange" not in plan(sample.bernoulli_sample(documents, "doc_id", 50.0, None))


def test_exact_quantiles_fold_lengths_first(documents):
    p = plan(profile.exact_quantiles(documents, "text"))
    assert "partial_count" in p and shuffles(profile.exact_quantiles(documents, "text")) == 1


def keyed(spark, documents):
    return documents.select(
        F.lit("NY").alias("collection"), F.lit(2001).alias("year"), F.col("doc_id").cast("string").alias("number"),
        F.col("n_chars").alias("bytes"), F.col("doc_id").alias("at"))


def test_pending_shuffles_each_side_once(spark, documents, folder):
    keyed(spark, documents).write.parquet(folder + "/m")
    manifest = spark.read.parquet(folder + "/m")
    pending = rulings.pending_documents(manifest, manifest, ["at"])
    assert shuffles(pending) <= 2
    assert "PushedFilters: [IsNotNull(bytes), GreaterThan(bytes,0)" in plan(pending)


def test_coverage_is_one_shuffle_per_level(spark, documents):
    k = keyed(spark, documents)
    p = plan(rulings.metadata_coverage(k, k))
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 2


def test_fresh_translation_shuffles_nothing(spark):
    cues = spark.createDataFrame([(1, 1, "a")], "file_id long, cue_no long, text string")
    assert "Exchange" not in plan(translate_cues(cues, glossary_model({})))


def test_first_pages_limit_rows_before_the_shuffle(documents):
    p = plan(ordered.paged_listing(documents.select("lang", "doc_id"), ["lang"], [F.desc("doc_id")], 100, max_pages=2))
    assert "WindowGroupLimit" in p and p.index("Final") < p.index("Partial")


def test_store_reads_only_earlier_batches(spark, documents, folder):
    schema = keyed(spark, documents).schema
    open_store(spark, folder, "main", schema)
    for i in range(3):
        write_batch(keyed(spark, documents), folder, "main", i)
    known = read_store(spark, folder, schema).where((F.col("run") != "main") | (F.col("batch") < 2)).select("number")
    assert "PartitionFilters: [(NOT (run" in plan(known)
    assert known.count() == 2 * documents.count()
    assert spark.read.parquet(batch_path(folder, "main", -1)).count() == 0


def test_size_comes_from_the_listing(spark):
    p = plan(files.dataset_bytes(spark, f"{SF_DIR}"))
    assert "content" not in p
