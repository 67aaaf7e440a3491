"""WARC archives: one gzip member per record, read back sequentially.

Writer: every row becomes a record (WARC/1.1), a gzip member of its own; rows with equal payloads of at
least ``min_payload`` bytes are one response (the smallest id) and revisits that refer to it.
Reader: incremental zlib decompression member by member, Content-Length framing, and verification of the
SHA-1 digests; a record whose frame or digest is wrong raises ValueError.

Archives are rows of (archive, data binary) of about ``archive_bytes``, each a .warc.gz stream of its own, in
a table of the shared folder, so that any file system Spark writes will do; ``export_files`` writes files.
The reader feeds a stream to zlib in chunks of ``CHUNK`` bytes, so its time is linear in the archive and it
holds one record at a time; records leave in batches of bounded size.

Edge cases: null payload: empty; a null id is a revisit of an equal payload with an id, else a response that
no record refers to; rows that repeat the smallest id of a payload are all responses; an empty table gives
no archive; ids are of any type that JSON text can carry and a cast reads back.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces

ARCHIVE_BYTES, CHUNK, BATCH_BYTES = 4 << 20, 1 << 16, 16 << 20
_DATE = "2020-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(x: object) -> str:
    return " ".join(str(x).split())


def record_bytes(key: object, uri: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """One record as a gzip member. A revisit keeps the digest of the full payload and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{uri}')}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": _header_value(uri or ""),
        "X-Page-Url": json.dumps(uri),
        "X-Page-Id": json.dumps(key),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": f"sha1:{digest_of(block)}",
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Length": str(len(block)),
    }
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Page-Id"] = json.dumps(refers_to)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a stream that comes in pieces of any length."""
    z, out, begun = zlib.decompressobj(31), [], False
    for data in chunks:
        while data:
            out.append(z.decompress(data))
            begun, data = True, b""
            if z.eof:
                data = z.unused_data  # at most a chunk
                yield b"".join(out)
                z, out, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends inside a record")


def chunked(data: bytes) -> Iterator[bytes]:
    view = memoryview(data)
    return (bytes(view[i : i + CHUNK]) for i in range(0, len(view), CHUNK))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, block and payload of one record; frame and digests are verified."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its Content-Length")
    if fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
        raise ValueError("a record's block differs from its digest")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest_of(payload)}":
        raise ValueError("a record's payload differs from its digest")
    return fields, block, payload


def write_archives(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Writes a record per row; returns the archives as rows (archive, seq, data), stored in the shared folder."""
    scratch = scratch or Scratch(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("k"), F.col(uri_col).alias("u"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("p"))
    keyed = scratch.save(rows.where(F.length("p") >= min_payload).select("k", F.sha1("p").alias("d")))
    first = scratch.save(keyed.groupBy("d").agg(F.min("k").alias("r"), F.count("*").alias("c")).where("c > 1 and r is not null").select("d", "r"))
    refers = scratch.save(keyed.join(first, "d").where("k is null or k <> r").dropDuplicates(["k", "d"]).select(F.col("k").alias("rk"), F.col("d").alias("rd"), "r"))
    marked = rows.withColumn("d", F.sha1("p")).join(refers, F.col("k").eqNullSafe(F.col("rk")) & (F.col("d") == F.col("rd")), "left").select("k", "u", "p", "r")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = uuid.uuid4().hex, [], 0
        for b in pieces(batches, 200):
            for k, u, p, r in zip(*(b.column(c).to_pylist() for c in ("k", "u", "p", "r"))):
                held.append(record_bytes(*(x if isinstance(x, str | int | None) else str(x) for x in (k, u)), p, r if isinstance(r, str | int | None) else str(r)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield _piece(name, held)
                    name, held, size = uuid.uuid4().hex, [], 0
        if held:
            yield _piece(name, held)

    out = scratch.save(marked.mapInArrow(run, "archive string, data binary"))
    scratch.drop(keyed, first, refers)
    return out


def _piece(name: str, held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"archive": [name], "data": pa.array([b"".join(held)], pa.binary())})


def read_archives(archives: DataFrame, *, id_kind: str = "bigint", payload: bool = False) -> DataFrame:
    """Records of archives, each read sequentially, ids as ``id_kind``: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits)."""
    fields = [("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payload)
    text = lambda x: None if (v := json.loads(x)) is None else str(v)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            got: list[tuple] = []
            size = 0
            for raw in members(chunked(b.column("data")[0].as_buffer())):
                f, _, body = parse_record(raw)
                row = (text(f["X-Page-Id"]), json.loads(f["X-Page-Url"]), int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], text(f.get("X-Refers-To-Page-Id", "null")))
                got.append(row + (body if f["WARC-Type"] == "response" else None,) * payload)
                size += 200 + (len(body) if payload else 0)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), schema.types)], schema=schema)
                    got, size = [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), schema.types)], schema=schema)

    out = archives.select("data").mapInArrow(run, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload)
    return out.withColumn("page_id", F.col("page_id").cast(id_kind)).withColumn("refers_to", F.col("refers_to").cast(id_kind))


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Puts each archive into ``folder`` (one that all executors mount) as <archive>.warc.gz; returns the paths and sizes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            done = []
            for name, data in zip(b.column("archive").to_pylist(), b.column("data").to_pylist()):
                path = os.path.join(folder, f"{name}.warc.gz")
                with open(f"{path}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.part", path)
                done.append((path, len(data)))
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "n_bytes": pa.array([n for _, n in done], pa.int64())})

    return archives.mapInArrow(run, "path string, n_bytes bigint")


def read_files(spark, pattern: str, **options) -> DataFrame:
    """Records of .warc.gz files written by ``export_files``."""
    files = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("archive"), F.col("content").alias("data"))
    return read_archives(files, **options)
