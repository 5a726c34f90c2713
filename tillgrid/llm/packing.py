"""Packing: concatenate all documents' ids and cut at every ``window`` ids.

Pass one encodes each document once and writes its ids with its place in its
partition. The partitions' totals, summed in order, give each partition the
ids that lie before it, and so each document its place in one stream that no
task ever holds. Pass two cuts documents where the stream passes a multiple
of the window; a document that crosses such a border yields a record on each
side. Only the last sequence is short.

Null text counts as empty: its one piece is the end id. Repeated rows are
packed as often as they occur. An empty table gives no pieces. Other columns
of the input are ignored; a null ``doc_id`` is carried as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, documents, map_arrow
from .tokens import RANKS, token_streams, vocabulary_path

WINDOW = 1024
END_ID = 0
#: Bytes of ids that a worker hands over at once.
CHUNK = 4 << 20


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian four-byte ids),
    ``doc_tokens``, ``sequence_id``, ``offset``."""
    streams = cut(token_streams(docs, path or vocabulary_path(RANKS), end_id), "token-streams", "zstd")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(streams.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "partition-offsets")
    placed = streams.join(bounded_broadcast(bases, bases.count(), 64), "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("at"), "width", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            row, start, length, ids, total, sequence, offset, held = [], [], [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                ints = [pa.array(x, pa.int64()) for x in (start, length, total, sequence, offset)]
                return pa.record_batch([batch.column("doc_id").take(pa.array(row, pa.int64())), *ints[:2], pa.array(ids, pa.binary()), *ints[2:]], names)

            for i, (at, width, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "width", "ids")), strict=True)):
                stream = np.frombuffer(packed, f"<u{width}").astype("<u4")
                n, done = len(stream), 0
                while done < n:
                    place = (at + done) % window
                    take = min(window - place, n - done)
                    row.append(i)
                    start.append(done)
                    length.append(take)
                    ids.append(stream[done : done + take].tobytes())
                    total.append(n)
                    sequence.append((at + done) // window)
                    offset.append(place)
                    done += take
                    held += take * 4
                    if held >= CHUNK:
                        yield out()
                        row, start, length, ids, total, sequence, offset, held = [], [], [], [], [], [], [], 0
            if row:
                yield out()

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(placed, run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``n_ids`` and ``ids``. A group holds one window at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("parts")).select(
        "sequence_id", "n_ids", F.aggregate("parts", F.lit(b""), lambda held, x: F.concat(held, x["ids"])).alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
