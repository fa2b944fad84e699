"""Web archives in Zstandard: writing, and reading record by record.

An archive starts with a skippable frame that holds the dictionary; every record
is one frame compressed with it.  The reader loads the dictionary, finds each
frame's end from its block headers, decodes one frame at a time, and checks
version, headers, lengths and digests; anything wrong is an error.

Of equal payloads the one with the smallest page id is written whole, the
others as revisit records that refer to it.

Defined results: a null payload counts as empty; pages without an id are always
written whole; rows that repeat id and payload are all written whole; an empty
table gives an empty archive folder and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import fresh_path, table, text_slices, written

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # capture time, where the pages have none

MIN_REVISIT_BYTES = 0  # smaller payloads are never written as revisits
ARCHIVE_BYTES = 8 << 20  # a new archive starts beyond this size
DICTIONARY_BYTES = 16 << 10
SAMPLE_RECORDS = 256  # records at an archive's start that its dictionary is made from
SAMPLE_BYTES = 2 << 10  # of each of them


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record: WARC headers, then the HTTP response (its headers alone for
    a revisit)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the starts of the records; of too few records, their bytes."""
    samples = [r[:SAMPLE_BYTES] for r in records]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:  # too little variety to train on
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES])


def _archives(records):
    """Archives (bytes, records) of at most about ARCHIVE_BYTES."""
    head: list[bytes] = []
    compressor, parts, size, n = None, [], 0, 0

    def start():
        nonlocal compressor, parts, size, n
        made = make_dictionary(head)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=True, write_checksum=True)
        content = made.as_bytes()
        parts, size, n = [struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content], len(content), 0
        for r in head:
            add(r)
        head.clear()

    def add(record: bytes):
        nonlocal size, n
        parts.append(compressor.compress(record))
        size += len(parts[-1])
        n += 1

    for record in records:
        if compressor is None:
            head.append(record)
            if len(head) == SAMPLE_RECORDS or sum(map(len, head)) > ARCHIVE_BYTES:
                start()
        else:
            add(record)
        if compressor is not None and size > ARCHIVE_BYTES:
            yield b"".join(parts), n
            compressor = None
    if head:
        start()
    if compressor is not None:
        yield b"".join(parts), n


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame that starts at ``at``, from its block headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != 0xFD2FB528:
        raise ValueError(f"no frame at byte {at}")
    flags = data[at + 4]
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            at += 4 if flags & 4 else 0
            if at > len(data):
                raise ValueError("a frame is cut off")
            return at


def parse_record(record: bytes) -> dict:
    """Headers, lengths and digests checked; the parts that readers want."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError(f"no {VERSION} record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - set(fields)
    if missing or fields["warc-type"] not in ("response", "revisit"):
        raise ValueError(f"missing headers {sorted(missing)} or unknown type")
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size} does not fit the record")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    lengths = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or len(lengths) != 1:
        raise ValueError("no HTTP headers")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    whole = fields["warc-type"] == "response"
    if whole and (len(payload) != lengths[0] or payload_digest(payload) != digest):
        raise ValueError("payload differs from its length or digest")
    if not whole and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit refers to a record and has no payload")

    def page(field: str) -> int | None:
        number = fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri", ""), "record_type": fields["warc-type"], "refers_to": page("warc-refers-to"),
        "payload_bytes": lengths[0], "payload_digest": digest, "payload": payload if whole else None,
    }


def read_archive(data: bytes):
    """The records of one archive, one frame at a time."""
    view = memoryview(data)
    if len(view) < 8:
        raise ValueError("no dictionary frame")
    magic, size = struct.unpack_from("<II", view)
    if magic != DICTIONARY_MAGIC or len(view) < 8 + size:
        raise ValueError("no dictionary frame")
    content = bytes(view[8 : 8 + size])
    if content[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be compressed itself
        content = zstandard.ZstdDecompressor().decompress(content)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    at = 8 + size
    while at < len(view):
        end = frame_end(view, at)
        yield parse_record(reader.decompress(view[at:end]))
        at = end


def _write_batches(folder: str):
    def run(batches):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        task = TaskContext.get().partitionId()

        def records():
            for batch in batches:
                for part in text_slices([batch], "html"):
                    for row in part.to_pylist():
                        yield record_bytes(row["page_id"], row["url"], row["html"].encode(), row["refers_to"])

        # Rows are sorted within the partition, so a task that runs again
        # writes the same files; a file appears whole or not at all.
        for k, (data, n) in enumerate(_archives(records())):
            name = f"part-{task:06d}-{k:04d}.warc.zst"
            hidden = f"{path}/_{name}.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(hidden) as out:
                out.write(data)
            system.move(hidden, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    return run


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``html`` and the page that a revisit refers to."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    known = base.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes)).select("page_id", "digest")
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # a table of two ids: a hot payload is split by AQE, and no html is moved by payload
    revisits = known.join(first, "digest").where(F.col("page_id") != F.col("refers_to")).distinct()
    return base.join(revisits, ["page_id", "digest"], "left").drop("digest")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` (a path or URI that every
    executor reaches); returns the table of archives."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    ready = with_revisits(pages, min_bytes).select("page_id", "url", "html", "refers_to").sortWithinPartitions("page_id", "url", "html")
    made = written(ready.mapInArrow(_write_batches(folder), "name string, records long, bytes long"), "warc-archives")
    return made


def _read_batches(batches):
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            rows, size = [], 0
            for record in read_archive(content.as_py()):
                rows.append(record)
                size += record["payload_bytes"]
                if size > 4 << 20:
                    yield _record_batch(path.as_py(), rows)
                    rows, size = [], 0
            if rows:
                yield _record_batch(path.as_py(), rows)


def _record_batch(path: str, rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *batch.columns], names=["path", *schema.names])


def read_archives(spark, folder: str) -> DataFrame:
    """Every record of the archives in ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(
        _read_batches, "path string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )


def op5_warc(spark, sf_dir):
    folder = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The digest column is the base32 form of SHA-1: DuckDB has SHA-1 in hex only,
# so five bits at a time are looked up.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: right(bin(CAST('0x1' || substr(hex, i, 1) AS BIGINT)), 4)), 'string_agg', '') AS bits FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
