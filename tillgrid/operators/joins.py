"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bound for an explicit broadcast hint. Above it the join is left to the
# planner (sort-merge, or a runtime broadcast if AQE measures a small side).
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# Upper bound for the hash table that a broadcast of such a side makes, on the driver and on every executor:
# files may hold its rows in a twentieth of that.
HELD_LIMIT_BYTES = 128 * 1024 * 1024

# The same for computed tables of a few numbers per row, whose rows were counted.
BROADCAST_LIMIT_ROWS = 200_000


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (no job is run).

    File scans report their on-disk size scaled by the projected columns.
    The gateway hands the JVM's big integer over as a Python int.
    """
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def sized_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only when its estimated size is under the limit.

    Otherwise the frame is returned untouched and the join shuffles both
    sides on the key, which holds at any size.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df


def held_bytes(df: DataFrame, rows: int) -> int:
    """About the bytes that ``rows`` rows of ``df`` take in the hash table of a broadcast join: words for null bits
    and columns, the text of strings, and an entry with its place in the table."""
    text = sum(16 for _, kind in df.dtypes if kind == "string")
    return rows * (8 + 8 * len(df.columns) + text + 40)


def fits_broadcast(df: DataFrame, limit_bytes: int = HELD_LIMIT_BYTES) -> bool:
    """Whether the hash table of ``df`` stays under the limit, by its counted rows (files of Parquet tell them in their footers)."""
    return held_bytes(df, df.count()) <= limit_bytes


def counted_broadcast(df: DataFrame, rows: int, limit_rows: int = BROADCAST_LIMIT_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if the ``rows`` that were counted are few.

    For small tables that were computed (a row per group, names of files): Catalyst's
    estimate goes by what they were made from, or is unknown, so it can't tell that they are small.
    """
    return F.broadcast(df) if rows <= limit_rows else df


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast a frame that is a global aggregate (exactly one row).

    A global aggregate without grouping keys always yields one row, so its
    size is bounded by construction.
    """
    return F.broadcast(df)
