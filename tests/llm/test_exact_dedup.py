"""Exact de-duplication against grouping in plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest

from corpuskit.llm.exact_dedup import drop_copies, exact_dedup, field_size, probe, repeated_cells

SCHEMA = "doc_id bigint, text string, keep_id string, row int, _no string, id string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 7, None, "y") for i, t in pairs], SCHEMA)


def expected(pairs):
    groups = defaultdict(list)
    for i, text in pairs:
        folded = re.sub(r"[\x20\x09-\x0d]+", " ", text or "")
        groups[hashlib.sha256(folded.encode()).hexdigest()].append(i)
    out = []
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, staying = (min(known) if known else None), 1
        for i in ids:
            kept = i == keep and staying == 1
            staying -= kept
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=repr)


PAIRS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (7, "long " * 50_000), (8, "long " * 50_000),
         (None, "x"), (None, "x"), (6, "once"), (6, "once"), (6, "once"), (10, "a b"), (None, "once"), (11, "é x")]


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_all_cases(spark, bits):
    got = exact_dedup(frame(spark, PAIRS).repartition(3), max_bits=bits)
    rows = [(r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()]
    assert sorted(rows, key=repr) == expected(PAIRS)


def test_full_field_changes_nothing(spark):
    """Far more rows than bits: nearly all are suspected, and the result is the same."""
    pairs = [(i, f"text {i % 60_000}") for i in range(70_000)]
    got = exact_dedup(frame(spark, pairs), max_bits=1 << 15)
    assert got.where("kept").count() == 60_000
    assert got.where("not kept and keep_id = id - 60000 and group_size = 2").count() == 10_000


def test_unique_rows_pass(spark):
    df = frame(spark, [(i, f"text {i}") for i in range(2_000)] + [(5_000, "text 0")])
    rows = exact_dedup(df).select("text_sha256")
    bits = field_size(2_001)
    probed = probe(rows, "text_sha256", repeated_cells(rows, "text_sha256", bits), bits, "again")
    assert 2 <= probed.where("again").count() < 200


def test_drop_copies_keeps_columns(spark):
    df = frame(spark, PAIRS)
    got = drop_copies(df)
    assert got.schema.names == df.schema.names
    assert got.count() == len({row[4] for row in expected(PAIRS)})
    assert {r.keep_id for r in got.collect()} == {"x"}


def test_empty(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    assert drop_copies(frame(spark, [])).count() == 0


def test_no_python(spark):
    plan = exact_dedup(frame(spark, PAIRS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
