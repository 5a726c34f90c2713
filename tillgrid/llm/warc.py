"""WARC archives compressed record by record with a dictionary of their own.

Each task writes one archive. It trains a Zstandard dictionary on its first
records, puts it into a leading skippable frame and compresses every record
as a frame of its own, so any record can be read alone with the file's head.
Archives are written by Spark's text writer, which commits files once per
task on whatever store the path names: a row is one frame, and the line
separator is an empty skippable frame, which every reader passes over. They
are read back whole, one file a row, by the binary file reader.

Of records with equal payloads of at least ``least`` bytes that with the
smallest page_id is a response and the others are revisits that refer to it;
smaller ones are all responses. Groups are found by digest with partial
aggregation, and only digests that repeat are joined back.

Null html is an empty payload; a null url leaves the header out. Rows that
repeat the smallest page_id of a group are all responses. A row without
page_id is a revisit if its group has an id, else a response. An empty table
gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.testdata import table
from .common import bounded_broadcast, cut, map_arrow, slices

#: Smallest payload that is archived once, bytes.
LEAST = 100
#: Bytes of records that a dictionary is trained on, its size, and the level of compression.
SAMPLE, DICTIONARY, LEVEL = 2 << 20, 48 << 10, 6
#: Magic numbers of Zstandard: the frame that holds a dictionary, and an empty skippable frame.
DICTIONARY_FRAME = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The tables hold no time of capture.
DATE = "1970-01-01T00:00:00Z"


def _name(page_id: object) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """One WARC record: the response with its payload, or the revisit with the head alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < "!" else c for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, head and payload of a record's HTTP message."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {headers.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or where the records are too few, the end of their bytes as plain content."""
    try:
        return zstandard.train_dictionary(DICTIONARY, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY:]


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The archive of ``records``, frame by frame; the first holds the dictionary."""
    first, size = [], 0
    for x in records:
        first.append(x)
        size += len(x)
        if size >= SAMPLE:
            break
    if not first:
        return
    trained = dictionary(first)
    yield struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained)).compress
    yield from map(compress, first)
    first.clear()
    yield from map(compress, records)


def unframe(archive: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The records of an archive; knows nothing of it but the frame formats."""
    data, at, read = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if magic == DICTIONARY_FRAME:
                read = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        one, parts = read.decompressobj(), []
        while not one.eof:
            chunk = data[at : at + step]
            if not chunk:
                raise ValueError("the archive ends inside a frame")
            parts.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> str:
    """Archive ``pages`` (``page_id``, ``url``, ``html``) under ``path``."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long_enough = F.octet_length("payload") >= least
    groups = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = cut(groups.where("n > 1 and first is not null").select("digest", "first"), "repeated-payloads")
    marked = rows.join(bounded_broadcast(repeated, repeated.count(), 160), "digest", "left").withColumn(
        "revisit", F.col("first").isNotNull() & F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in slices(batches, "payload"):
                for x in batch.to_pylist():
                    yield record(x["page_id"], x["url"], x["payload"], x["digest"], x["first"], x["revisit"])

        held: list[bytes] = []
        for frame in frames(records()):
            held.append(frame)
            if sum(map(len, held)) >= 1 << 20 or len(held) >= 256:
                yield pa.record_batch([pa.array(held, pa.binary())], ["value"])
                held = []
        if held:
            yield pa.record_batch([pa.array(held, pa.binary())], ["value"])

    columns = marked.select("page_id", "url", "payload", "digest", "first", "revisit")
    map_arrow(columns, run, "value binary").select(F.col("value").cast("string").alias("value")).write.option(
        "lineSep", SEPARATOR.decode()).text(path)
    return path


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records below ``path``: ``page_id``, ``url``, ``record_type``, ``refers_to``,
    ``payload_bytes``, ``payload_digest`` and ``payload`` (null for revisits, or without ``payloads``).
    A response whose payload doesn't have the digest it states is an error."""

    def number(name: str | None) -> int | None:
        return int(name[len("<urn:x-page:") : -1]) if name and len(name) > len("<urn:x-page:>") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for archive in batch.column("content"):
                rows, size = [], 0
                for raw in unframe(archive.as_py()):
                    headers, http, payload = parse(raw)
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    stated = int(http.rsplit(b"Content-Length: ", 1)[1])
                    if kind == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                    rows.append((number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, number(headers.get("WARC-Refers-To")), stated, digest,
                                 payload if payloads and kind == "response" else None))
                    size += len(payload) * payloads + 200
                    if size >= 8 << 20:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return map_arrow(files.select("content"), run,
                     "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, f"warc-{uuid.uuid4().hex}"))
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Equal payloads are found by their text; DuckDB's sha256 takes it as UTF-8.
OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT payload, min(page_id) AS first FROM p WHERE strlen(payload) >= {LEAST} GROUP BY payload)
SELECT p.page_id, CAST(strlen(p.payload) AS BIGINT) AS payload_bytes, sha256(p.payload) AS payload_digest,
       CASE WHEN g.first IS NULL OR (p.page_id IS NOT NULL AND p.page_id = g.first) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first IS NOT NULL AND (p.page_id IS NULL OR p.page_id <> g.first) THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.payload = g.payload
"""
