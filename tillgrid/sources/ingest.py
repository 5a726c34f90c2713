"""Bucketed ingest (S6, C1): fact and order tables written once, co-partitioned by the key they are joined on.

Both tables are dealt by the hash of the order key into the same number of
buckets, one sorted file per bucket, and registered in the session's catalog.
A join on the key then reads bucket against bucket: neither side is shuffled,
however often the sales view is prepared from them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import estimated_bytes
from ..session import scratch_path

#: Bytes that a bucket of the larger table holds on average (a task sorts it decoded, ten times as large), and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 1 << 16


def bucket_count(size: int, bucket_bytes: int = BUCKET_BYTES, least: int = 8) -> int:
    """A power of two of buckets that hold about ``bucket_bytes`` each, so tables ingested at other sizes divide evenly."""
    buckets = least
    while buckets < MOST_BUCKETS and buckets * bucket_bytes < size:
        buckets *= 2
    return buckets


def ingest_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to ``path`` in ``buckets`` sorted buckets of ``key``, register it as ``table`` and return it.

    The rows are dealt by the same hash as the buckets first, so each task
    writes one file and a bucket is one file. Rows without a key are in one
    bucket and join with nothing.
    """
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).format("parquet").saveAsTable(table))
    return df.sparkSession.table(table)


@dataclass
class Ingested:
    """The two sides of the fact join as registered tables."""

    lineitem: DataFrame
    orders: DataFrame
    buckets: int


def ingest_facts(spark: SparkSession, lineitem: DataFrame, orders: DataFrame, base: str | None = None, buckets: int | None = None) -> Ingested:
    """Ingest the fact table and its orders by order key, under ``base`` (default: the shared checkpoint folder)."""
    tag = uuid.uuid4().hex
    base = base or scratch_path(spark, f"ingested-{tag}")
    buckets = buckets or bucket_count(max(estimated_bytes(lineitem), estimated_bytes(orders)))
    return Ingested(ingest_bucketed(lineitem, f"lineitem_{tag}", f"{base}/lineitem", "l_orderkey", buckets),
                    ingest_bucketed(orders, f"orders_{tag}", f"{base}/orders", "o_orderkey", buckets), buckets)
