"""WARC archives: round trip, checks of the reader, and foreign dictionaries."""

import hashlib
import io
import struct
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from corpuskit.llm import warc

SCHEMA = "page_id bigint, url string, html string, path string, _digest string"
BIG = "<p>" + "x" * 200
ROWS = [(3, "http://a/", BIG), (1, "http://b/ c\n", BIG), (2, None, BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None),
        (7, "u", ""), (None, "u", BIG), (None, "u", "y" * 150), (None, "u", "y" * 150), (8, "u", "long é " * 400_000),
        (8, "u", "long é " * 400_000), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20)]


def written(spark, folder, rows=ROWS, **how):
    df = spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA).repartition(3)
    manifest = warc.write_archives(df, folder, **how)
    return manifest, warc.read_archives(spark, manifest, folder).collect()


@pytest.mark.parametrize("archive_bytes", [1, 64 << 20])
def test_round_trip(spark, folder, archive_bytes):
    manifest, records = written(spark, folder, archive_bytes=archive_bytes)
    assert {r.problem for r in records} == {None}
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS) == len(records)
    if archive_bytes == 1:
        assert manifest.count() == len(ROWS)
    got = {}
    for r in records:
        got.setdefault(r.record_id, []).append((r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload))
    for page, _, html in ROWS:
        body = (html or "").encode()
        kind, refers, n, digest, payload = got[warc.urn(page).strip("<>")].pop()
        if page is not None:
            assert (n, digest) == (len(body), hashlib.sha256(body).hexdigest())
            assert (kind, refers) == (("revisit", "urn:page:1") if page in (2, 3) else ("response", None))
            assert payload == (None if kind == "revisit" else body)
    uris = {r.target_uri for r in records}
    assert "http://b/%20c%0A" in uris and None in uris


def test_empty_table(spark, folder):
    manifest, records = written(spark, folder, [])
    assert manifest.count() == 0 and records == []


def test_archives_have_dictionary_and_one_frame_per_record(spark, folder):
    rows = [(i, f"http://h/{i}", f"<html>page {i} of the same site {i * 7}</html>" * 20) for i in range(300)]
    manifest, records = written(spark, folder, rows)
    assert {r.problem for r in records} == {None} and len(records) == 300
    raw = (Path(folder) / manifest.first().path).read_bytes()
    kind, length = struct.unpack("<II", raw[:8])
    assert kind == 0x184D2A5D and raw[8:12] == b"\x37\xa4\x30\xec"
    first = min(r.position for r in records if r.archive == manifest.first().path)
    assert first == 8 + length
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(raw[first:], max_output_size=1 << 20)


def archive(frames, dictionary=b""):
    head = struct.pack("<II", 0x184D2A5D, len(dictionary)) + dictionary if dictionary else b""
    return io.BytesIO(head + b"".join(frames))


def test_compressed_dictionary_and_other_skippable_frames():
    samples = [f"header {i} value {i * 31} tail".encode() * 5 for i in range(500)]
    trained = zstandard.train_dictionary(4096, samples)
    press = zstandard.ZstdCompressor(dict_data=trained)
    frames = [press.compress(s) for s in samples[:3]]
    frames.insert(1, struct.pack("<II", 0x184D2A50, 5) + b"skip!")
    stored = zstandard.ZstdCompressor().compress(trained.as_bytes())
    assert [c for _, c in warc.read_frames(archive(frames, stored))] == samples[:3]


def record(block=b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi", kind="response", tail=b"\r\n\r\n", length=None, first=b"WARC/1.1", drop=""):
    lines = {"WARC-Type": kind, "WARC-Record-ID": "<urn:page:1>", "WARC-Date": "2024-01-01T00:00:00Z",
             "WARC-Payload-Digest": "sha256:" + hashlib.sha256(b"hi").hexdigest(),
             "Content-Length": str(len(block) if length is None else length)}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items() if k != drop)
    return first + b"\r\n" + head + b"\r\n" + block + tail


@pytest.mark.parametrize(("bad", "says"), [
    (record(), None),
    (record(first=b"WARC/3.0"), "no WARC header"),
    (record(drop="WARC-Date"), "no warc-date"),
    (record(length=7), "another length"),
    (record(length="x"), "another length"),
    (record(tail=b"\r\n"), "another length"),
    (record(block=b"no header"), "no HTTP header"),
    (record(block=b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nhi"), "the payload has another length"),
    (record(block=b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nho"), "another digest"),
    (record(kind="revisit"), "a revisit with payload"),
    (b"", "no WARC header"),
])
def test_reader_validates(bad, says):
    problem = warc.decode_record(bad)["problem"]
    assert problem is None if says is None else says in problem


def test_broken_archives_are_reported(spark, folder):
    whole = zstandard.ZstdCompressor().compress(record())
    for name, raw in {"cut": whole + whole[:-3], "junk": b"not zstd at all", "skip": struct.pack("<II", 0x184D2A5D, 90) + b"x"}.items():
        (Path(folder) / name).write_bytes(raw)
    manifest = spark.createDataFrame([("cut",), ("junk",), ("skip",)], "path string")
    got = warc.read_archives(spark, manifest, folder).collect()
    assert sorted(r.archive for r in got if r.problem) == ["cut", "junk", "skip"]
    assert [r.archive for r in got if not r.problem] == ["cut"]
