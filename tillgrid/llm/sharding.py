"""Sharding by sampled splitters: ranges of a hashed key, cut into shards of near equal bytes.

A record's key is the hash of its text, then of its id, so equal texts lie
side by side and still no key is too large to cut. Keys are drawn with a
chance in proportion to the record's size; the quantiles of the draw are the
splitters of many small ranges. Exact totals per range follow, and a range
that came out overfull is drawn from again, more densely, and subdivided.
Running sums of sizes over the ranges and then inside each give every record
its exact place in one order; shard ``k`` takes the records whose middle byte
lies in the k-th of ``shards`` equal parts. Sizes of two shards so differ by
less than the largest record's size, and a group of equal texts is cut only
where a border falls into it.

Size is the text's bytes plus 8. Null text counts as no bytes (checksum 0);
null ids hash like a value of their own. Fully repeated rows are told apart by
their place in the written table, so any number of them can be cut. An empty
table gives no rows; with fewer records than shards some shards are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, documents, map_arrow

SHARDS = 24
#: Extra bytes counted for each record.
OVERHEAD = 8
#: Least ranges per shard, records meant for a range, and draws per range.
RANGES, RECORDS, DRAWS = 8, 250_000, 32
#: A range is overfull from this multiple of its even part on.
OVERFULL = 2.0


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32`` and the two-part key, written once."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    low = F.lit((1 << 24) - 1)
    tie = F.xxhash64("doc_id").bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(low))
    return cut(docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
                           F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("key"), tie.alias("tie")), "shard-keys")


def draw(records: DataFrame, per_byte: float) -> list[tuple[int, int, float]]:
    """Keys drawn with chance size x ``per_byte`` (certain ones weigh more), in order."""
    chance = F.col("size") * F.lit(per_byte)
    die = F.pmod(F.xxhash64("key", "tie", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = records.where(die < chance).select("key", "tie", F.greatest(F.lit(1.0), chance).alias("weight"))
    return sorted((r["key"], r["tie"], r["weight"]) for r in drawn.collect())


def quantiles(drawn: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """At most ``parts`` - 1 keys that cut the drawn weight evenly."""
    total, seen, out = sum(w for *_, w in drawn), 0.0, []
    for key, tie, weight in drawn:
        seen += weight
        if seen >= total * (len(out) + 1) / parts and len(out) < parts - 1:
            out.append((key, tie))
    return out


def place(key: np.ndarray, tie: np.ndarray, borders: list[tuple[int, int]]) -> np.ndarray:
    """The range of each key: how many borders lie below it."""
    keys, ties = (np.array([b[i] for b in borders], np.int64) for i in (0, 1))
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    for k in np.unique(key[low < high]):
        own = np.flatnonzero(key == k)
        a, z = low[own[0]], high[own[0]]
        low[own] = a + np.searchsorted(ties[a:z], tie[own], "left")
    return low.astype(np.int32)


def in_ranges(records: DataFrame, borders: list[tuple[int, int]]) -> DataFrame:
    held = records.sparkSession.sparkContext.broadcast(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = place(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tie")), held.value)
            yield pa.record_batch([*batch.columns, pa.array(found)], [*batch.schema.names, "range"])

    return map_arrow(records, run, ", ".join(f"{c} {t}" for c, t in records.dtypes) + ", range int")


def splitters(records: DataFrame, shards: int, rows: int, total: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """The ranges' borders, and the exact (bytes, records) of each range."""
    parts = max(shards * RANGES, -(-rows // RECORDS))
    borders = quantiles(draw(records, parts * DRAWS / total), parts)
    for dense in (1, 8, 64, 512):
        ranged = in_ranges(records, borders)
        sums = {r["range"]: (r["b"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        over = {k: b for k, (b, n) in sums.items() if n > 1 and b > OVERFULL * total / parts}
        more: list[tuple[int, int]] = []
        if over:
            drawn = draw(ranged.where(F.col("range").isin([int(k) for k in over])), dense * parts * DRAWS / total)
            where = place(np.array([d[0] for d in drawn], np.int64), np.array([d[1] for d in drawn], np.int64), borders)
            for k, b in over.items():
                own = [d for d, at in zip(drawn, where.tolist(), strict=True) if at == k]
                more += quantiles(own, int(np.ceil(b * parts / total)))
        new = sorted({*borders, *more})
        if len(new) == len(borders):
            break
        borders = new
    return borders, sums


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` per row of ``docs``."""
    records = keyed(docs)
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return records.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    borders, _ = splitters(records, shards, rows, total)
    ranged = cut(in_ranges(records, borders), "shard-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(ranged.groupBy("range").agg(F.sum("size").alias("bytes")).select(
        "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "shard-bases")  # a row per range
    inside = Window.partitionBy("range").orderBy("key", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(bounded_broadcast(bases, len(borders) + 1, 64), "range").withColumn("until", F.sum("size").over(inside))
    # Whole numbers throughout: the middle byte's share of the total, in shards.
    middle = f"((base + until) * 2 - size) * {shards} div {2 * total}"
    placed = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, {middle}) as int)"))
    order = Window.partitionBy("range", "shard").orderBy("key", "tie", "doc_id")
    placed = cut(placed.withColumn("row", F.row_number().over(order)).select("doc_id", "size", "text_crc32", "range", "shard", "row"), "shard-places")
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n")).select(
        "shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    return placed.join(bounded_broadcast(counts, len(borders) + 1 + shards, 64), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("row") - 1).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
