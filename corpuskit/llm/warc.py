"""WARC archives of one Zstandard frame per record, with a shared dictionary in front.

An archive begins with a skippable frame that holds the dictionary (if there is one). Each record
is a frame of its own. Tasks write archives of bounded size to a shared folder; the archives of
a lost or repeated task stay unlisted, for only a committed manifest says what belongs to the set.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.sampling import picked
from corpuskit.session import materialise

# Fixed values of the formats.
VERSION = b"WARC/1.1"
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
ZSTD_DICTIONARY = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RECORD_URN = "urn:page:"

ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 100
READ_BYTES = 1 << 20

MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = """archive string, position bigint, record_id string, record_type string, target_uri string,
refers_to string, payload_digest string, payload_bytes bigint, payload binary, problem string"""


def train_dictionary(
    df: DataFrame, payload_col: str, size: int = 64 << 10, pages: int = 256, page_bytes: int = 16 << 10
) -> bytes:
    """A compression dictionary from a bounded sample: ``pages`` payloads, the head of each.

    Rows are picked by the hash of their payload. Compression only depends on it, never the
    content of an archive. Too small a sample gives no dictionary.
    """
    head = F.substring(F.col(f"`{payload_col}`").cast("binary"), 1, page_bytes).alias("head")
    some = picked(["head"], 2 * pages, df.count())
    # Taken from one partition after the other, so that no more than ``pages`` of them get here.
    heads = df.select(head).where(some & (F.length("head") > 0)).limit(pages)
    samples = [bytes(row.head) for row in heads.collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def mark_revisits(df: DataFrame, id_col: str, payload_col: str, at_least: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``_digest`` and, to every payload of ``at_least`` bytes seen before, ``_refers``.

    The smallest id of equal payloads is no revisit, nor is a row without id if there is no other.
    """
    digested = df.withColumn("_digest", F.sha2(F.col(payload_col), 256))
    firsts = materialise(
        digested.where(F.length(payload_col) >= at_least).groupBy("_digest")
        .agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null"),
        "firsts")
    joined = digested.join(firsts.drop("_n"), "_digest", "left")
    return joined.withColumn("_refers", F.when(~F.col("_first").eqNullSafe(F.col(id_col)), F.col("_first"))).drop("_first")


def urn(page_id) -> str:
    return f"<{RECORD_URN}{'' if page_id is None else page_id}>"


def encode_record(page_id, url: str | None, payload: bytes, digest: str, refers, date: str) -> bytes:
    """One record; a revisit keeps the HTTP headers and leaves out the payload."""
    http = HTTP_OK.format(len(payload)).encode()
    block = http if refers is not None else http + payload
    lines = [
        ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", urn(page_id)),
        ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(("WARC-Target-URI", safe))
    if refers is not None:
        lines += [("WARC-Refers-To", urn(refers)), ("WARC-Profile", PROFILE)]
    lines.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"
    return head + block + b"\r\n\r\n"


def _write_partition(batches, folder: str, dictionary: bytes, date: str, archive_bytes: int, level: int):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
    store, base = fs.FileSystem.from_uri(folder)
    out, name, records, size = None, "", 0, 0

    def closed():
        out.close()
        return pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [size]})

    for batch in batches:
        ids, urls, payloads, digests, refers = batch.columns
        for i in range(batch.num_rows):
            if out is None:
                name, records = f"{uuid.uuid4().hex}.warc.zst", 0
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                head = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""
                out.write(head)
                size = len(head)
            frame = press.compress(encode_record(
                ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), digests[i].as_py(), refers[i].as_py(), date))
            out.write(frame)
            records, size = records + 1, size + len(frame)
            if size >= archive_bytes:
                yield closed()
                out = None
    if out is not None:
        yield closed()


def write_archives(
    df: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
    level: int = 3,
) -> DataFrame:
    """Writes a record per row and returns the manifest: ``path`` in ``folder``, ``records``, ``bytes``.

    A null payload is written as an empty one, a null url leaves the header out; a null id gives a
    record identifier without a number. Repeated ids are repeated records. ``folder`` is one all
    executors reach. An archive is closed once it has ``archive_bytes``, so a task holds one record in memory.
    """
    pages = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    dictionary = train_dictionary(pages, "payload")
    marked = mark_revisits(pages, "id", "payload").select("id", "url", "payload", "_digest", "_refers")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    write = partial(_write_partition, folder=folder, dictionary=dictionary, date=date,
                    archive_bytes=archive_bytes, level=level)
    return materialise(marked.mapInArrow(write, MANIFEST), "manifest")


def load_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    """A dictionary as it stands in a skippable frame: plain, or itself compressed."""
    if raw[:4] == ZSTD_FRAME:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if raw[:4] != ZSTD_DICTIONARY:
        raise ValueError("the leading skippable frame holds no dictionary")
    return zstandard.ZstdCompressionDict(raw)


def read_frames(stream) -> Iterator[tuple[int, bytes]]:
    """Position and content of each frame, one at a time; other skippable frames are passed over."""
    held, position, shared = b"", 0, None

    def fill(n: int) -> None:
        nonlocal held
        while len(held) < n and (more := stream.read(max(READ_BYTES, n - len(held)))):
            held += more

    while True:
        fill(8)
        if not held:
            return
        if len(held) >= 8 and struct.unpack("<I", held[:4])[0] & 0xFFFFFFF0 == 0x184D2A50:
            kind, length = struct.unpack("<II", held[:8])
            fill(8 + length)
            if len(held) < 8 + length:
                raise ValueError("a skippable frame is cut off")
            if kind == DICTIONARY_FRAME and position == 0:
                shared = load_dictionary(held[8 : 8 + length])
            held, position = held[8 + length :], position + 8 + length
            continue
        frame = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
        parts, began = [], position
        while not frame.eof:
            fill(1)
            if not held:
                raise ValueError("a frame is cut off")
            parts.append(frame.decompress(held))
            position += len(held) - len(frame.unused_data)
            held = frame.unused_data
        yield began, b"".join(parts)


def decode_record(record: bytes) -> dict:
    """Fields of one record. ``problem`` says what is wrong with it, if anything is."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    found = {k.strip().lower(): v.strip() for k, colon, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:]) if colon}
    out = {
        "record_id": found.get("warc-record-id", "").strip("<>"), "record_type": found.get("warc-type"),
        "target_uri": found.get("warc-target-uri"), "refers_to": found.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": found.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "payload_bytes": None, "payload": None, "problem": None,
    }
    length = found.get("content-length", "")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return out | {"problem": "no WARC header"}
    if missing := [name for name in MANDATORY if not found.get(name)]:
        return out | {"problem": f"no {missing[0]}"}
    if not re.fullmatch("[0-9]+", length) or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "the block has another length than its header says"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    declared = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
    if not gap or not http.startswith(b"HTTP/") or not declared:
        return out | {"problem": "no HTTP header"}
    out["payload_bytes"] = int(declared[1])
    if out["record_type"] == "revisit":
        return out if not payload and out["refers_to"] else out | {"problem": "a revisit with payload or without target"}
    out["payload"] = payload
    if len(payload) != out["payload_bytes"]:
        return out | {"problem": "the payload has another length than its header says"}
    if hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        return out | {"problem": "the payload has another digest than its header says"}
    return out


def _read_partition(batches, folder: str, batch_bytes: int = 4 << 20):
    store, base = fs.FileSystem.from_uri(folder)
    names = [x.split()[0] for x in RECORDS.split(",")]
    kinds = {"position": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, held = [], 0
            with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                frames = read_frames(stream)
                while True:
                    try:
                        position, content = next(frames)
                    except StopIteration:
                        break
                    except (ValueError, zstandard.ZstdError) as wrong:
                        rows.append({"archive": path, "problem": str(wrong)})
                        break
                    rows.append({"archive": path, "position": position} | decode_record(content))
                    held += len(content)
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives that ``manifest`` lists by ``path`` in ``folder``.

    A record that fails a check is returned with its ``problem``; an archive that can't be decoded
    any further ends with a row that says so. One task reads one archive, record by record.
    """
    archives = max(1, manifest.count())
    # Round robin, one archive to a task: the size of an archive, not its number, is bounded.
    return manifest.select("path").repartition(archives).mapInArrow(partial(_read_partition, folder=folder), RECORDS)
