"""WARC archives as chunked record tables.

An archive is a WARC 1.1 byte stream held as rows (archive, record, record_id,
chunk, data, size, sha1): a record's header is chunk 0, its payload follows in
chunks of bounded size, and its last row ends it.  The stream is the rows' data
in order, so archives can be stored wherever Spark writes tables, and be
exported as files.  Payloads are cut where Arrow holds their UTF-8 bytes and
never copied whole; digests are carried from chunk to chunk, written in a
record's last row.  Reading is a state machine over data that emits (record,
chunk) rows and keeps only a header or one chunk at a time, whatever a record's
size.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored

CHUNK = 64 * 1024
#: Bytes of chunk rows that a writer holds before it hands them on.
HELD = 4 * 1024 * 1024
SCHEMA = "archive string, record long, record_id string, chunk long, data binary, size long, sha1 string"
_ROWS = pa.schema([("archive", pa.string()), ("record", pa.int64()), ("record_id", pa.string()), ("chunk", pa.int64()), ("data", pa.binary()), ("size", pa.int64()), ("sha1", pa.string())])
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uuid(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def payloads(texts: pa.StringArray) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text where Arrow holds them; nulls are empty."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else []
    held = memoryview(data) if data is not None else memoryview(b"")
    known = texts.is_valid().to_pylist()
    for i, there in enumerate(known):
        yield held[ends[i] : ends[i + 1]] if there else held[:0]


def chunks_of(payload: memoryview) -> Iterator[memoryview]:
    for at in range(0, len(payload), CHUNK):
        yield payload[at : at + CHUNK]


@F.arrow_udf(T.StructType().add("payload_bytes", "long").add("sha1", "string"))
def digest(texts: pa.Array) -> pa.Array:
    """Size and SHA-1 (hex) of each text's UTF-8 bytes, chunk by chunk."""
    sizes, sums = [], []
    for payload in payloads(texts):
        sha1 = hashlib.sha1()
        for chunk in chunks_of(payload):
            sha1.update(chunk)
        sizes.append(len(payload))
        sums.append(sha1.hexdigest())
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], ["payload_bytes", "sha1"])


def dedup_plan(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, html) with the record each becomes.

    Adds payload_bytes, sha1 (hex) and refers_to: of equal payloads of at least
    ``least`` bytes, that with the largest page_id stays a response (refers_to
    null), and the others refer to it.  Equality is of SHA-1 and length.  A
    digest shared by very many pages is combined before the shuffle to one row;
    rows with a null id are always responses, null html is an empty payload.
    Rows that share an id are records of their own under one record id, and
    share their part: either all are the response or all refer to it.  Other
    columns of ``pages`` are left behind whatever their names.
    """
    html = F.col("html").cast("string")
    # The digest's own payload stays where it was read: only ids and digests are shuffled here.
    sums = pages.select(F.col("page_id").cast("long").alias("page_id"), digest(html).alias("d")).select("page_id", "d.*")
    groups = sums.where(F.col("payload_bytes") >= least).groupBy(F.col("sha1").alias("_sha1"), F.col("payload_bytes").alias("_bytes"))
    groups = groups.agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    digests = stored(groups, "warc-groups")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("d", digest("html")).select("page_id", "url", "html", "d.*")
    same = (F.col("sha1") == F.col("_sha1")) & (F.col("payload_bytes") == F.col("_bytes"))
    out = rows.join(digests, same, "left")
    refers = F.when(F.col("_last") != F.col("page_id"), F.col("_last"))
    return out.select("page_id", "url", "html", "payload_bytes", "sha1", refers.alias("refers_to"))


def _header(page_id, url, size: int, sha1: str, refers_to) -> bytes:
    """A record's header and the HTTP header that its block begins with."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uuid(page_id)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}" if url is not None else None,
        f"X-Page-ID: {page_id}" if page_id is not None else None,
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_uuid(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return "\r\n".join(h for h in head if h).encode() + b"\r\n\r\n" + http


def write_archives(planned: DataFrame, archive_bytes: int = 64 << 20) -> DataFrame:
    """WARC archives of :func:`dedup_plan`'s rows, written as chunk rows.

    Each task writes one archive after another, each closed with the record that
    brings it to ``archive_bytes``, so that one reader's share stays bounded.
    ``size`` counts a record's payload bytes up to its row's end, and its last
    row has the SHA-1 that was carried along, null for revisits, whose payload
    is not written again.  An archive's name tells its task, so a task that is
    run again writes the same archives.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, record, total, waiting = TaskContext.get().partitionId(), 0, 0, 0, 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)
            rows.clear()
            waiting = 0
            return out

        for batch in slices(batches, 2):
            others = (batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5))
            for payload, page_id, url, size, sum_before, refers_to in zip(payloads(batch.column(2)), *others, strict=True):
                name, record_id = f"{task:06d}-{serial:05d}", record_uuid(page_id)
                sha1, done, chunk = hashlib.sha1(), 0, 0
                parts = (_header(page_id, url, size, sum_before, refers_to), *(chunks_of(payload) if refers_to is None else ()))
                for chunk, data in enumerate(parts):
                    if chunk:
                        sha1.update(data)
                        done += len(data)
                    rows.append((name, record, record_id, chunk, bytes(data), done, None))
                    waiting += len(data)
                    if waiting >= HELD:
                        yield flush()
                rows.append((name, record, record_id, chunk + 1, b"\r\n\r\n", done, sha1.hexdigest() if refers_to is None else None))
                record += 1
                total += len(parts[0]) + done
                if total >= archive_bytes:
                    serial, record, total = serial + 1, 0, 0
        if rows:
            yield flush()

    rows = planned.select("page_id", "url", "html", "payload_bytes", "sha1", "refers_to")
    return stored(rows.mapInArrow(write, SCHEMA), "warc")


def _in_order(archives: DataFrame) -> DataFrame:
    """Every archive's (archive, data) in one task, in order; as many tasks as there are archives."""
    n = archives.agg(F.count_distinct("archive")).first()[0]
    rows = archives.select("archive", "record", "chunk", "data").repartition(max(1, n), "archive").sortWithinPartitions("archive", "record", "chunk")
    return rows.select("archive", "data")


class Reader:
    """Incremental WARC parser: feed bytes, get (header, chunk, data, state).

    Events are ("chunk", header, number, bytes) for payload chunks and
    ("end", header, payload size, hex SHA-1 of the payload) once a record is over.
    Payload means the block behind its HTTP header, or the whole block of
    records that are not HTTP.
    """

    def __init__(self):
        self.buffer = bytearray()
        self.header: dict[str, str] | None = None
        self.left = self.size = self.number = 0
        self.http = False

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.buffer += data
        while True:
            if self.header is None:
                while self.buffer[:2] == b"\r\n":
                    del self.buffer[:2]
                end = self.buffer.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = self.buffer[:end].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
                del self.buffer[: end + 4]
                self.header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.left = int(self.header["content-length"])
                self.http = self.header.get("content-type", "").startswith("application/http")
                self.size = self.number = 0
                self.digest = hashlib.sha1()
            if self.http:
                end = self.buffer.find(b"\r\n\r\n", 0, self.left)
                if end < 0 and len(self.buffer) < self.left:
                    return
                skip = end + 4 if end >= 0 else 0
                del self.buffer[:skip]
                self.left -= skip
                self.http = False
            while self.left and len(self.buffer) >= min(CHUNK, self.left):
                chunk = bytes(self.buffer[: min(CHUNK, self.left)])
                del self.buffer[: len(chunk)]
                self.left -= len(chunk)
                self.size += len(chunk)
                self.digest.update(chunk)
                yield "chunk", self.header, self.number, chunk
                self.number += 1
            if self.left:
                return
            done, self.header = self.header, None
            yield "end", done, self.size, self.digest.hexdigest()

    def close(self) -> None:
        if self.header is not None or self.buffer.strip(b"\r\n"):
            raise ValueError("the archive ends inside a record")


def _hex_digest(header: dict[str, str]) -> str:
    return base64.b32decode(header["warc-payload-digest"].removeprefix("sha1:")).hex()


def read_archives(archives: DataFrame, chunks: bool = False) -> DataFrame:
    """Records of archives: one row each, or with ``chunks`` a row per chunk.

    A record's row has the id and type of its header, the size and SHA-1 of
    its full payload, and what it refers to.  Response payloads are digested as
    they stream by and held against the header's digest; a revisit has none, so
    its header's figures stand.  Chunk rows carry the record's id, the chunk's
    number and bytes.  An archive is read by one task, in the order of its rows.
    """

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader = None, Reader()
        for batch in slices(batches, 1, 10_000, HELD):
            rows: list[tuple] = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != current:
                    reader.close()
                    current, reader = name, Reader()
                for kind, header, a, b in reader.feed(data):
                    if chunks and kind == "chunk":
                        rows.append((header["warc-record-id"], a, b))
                    elif not chunks and kind == "end":
                        revisit = header["warc-type"] == "revisit"
                        if not revisit and _hex_digest(header) != b:
                            raise ValueError(f"payload of {header['warc-record-id']} differs from its digest")
                        page, to = header.get("x-page-id"), header.get("x-refers-to-page")
                        rows.append(
                            (page and int(page), header.get("warc-target-uri"), header["warc-record-id"], header["warc-type"])
                            + ((int(header["x-payload-length"]), _hex_digest(header)) if revisit else (a, b))
                            + (to and int(to),)
                        )
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        reader.close()

    if chunks:
        names, kinds, schema = ["record_id", "chunk", "data"], [pa.string(), pa.int64(), pa.binary()], "record_id string, chunk long, data binary"
    else:
        names = ["page_id", "url", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        schema = "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return _in_order(archives).mapInArrow(records, schema)


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as ``<folder>/<archive>.warc`` and return (archive, bytes).

    ``folder`` is a path or URI that Arrow's file systems open on every
    executor.  A file is written under a name of its attempt and then renamed,
    so a lost task leaves no half archive under the final name.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        current, out, size, done = None, None, 0, []
        attempt = TaskContext.get().taskAttemptId()

        def finish() -> None:
            if out is not None:
                out.close()
                files.move(f"{root}/.{current}-{attempt}", f"{root}/{current}.warc")
                done.append((current, size))

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != current:
                    finish()
                    current, size = name, 0
                    out = files.open_output_stream(f"{root}/.{name}-{attempt}")
                out.write(data)
                size += len(data)
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "bytes"])

    return _in_order(archives).mapInArrow(write, "archive string, bytes long")
