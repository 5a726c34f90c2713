"""Job history, status timelines and operational alarms (T5-T10, W6, W7, X1-X3 batch form).

Operators take column names so they work on a jobs table, a job-event
timeline or any event log. Skew: "latest per key" is an aggregate
(``max_by``), partially aggregated map-side, so a key holding a third of
all rows costs one row per task before the shuffle. Per-key top-n uses
``row_number() <= n`` which Spark plans with a partial WindowGroupLimit
before the shuffle, so only n rows per key per task move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_status, parse_log_line, status_badge
from .quantiles import exact_quantiles


def _order(ts: str, tiebreak: str | None, desc: bool = True) -> list[Column]:
    cols = [F.col(ts).desc() if desc else F.col(ts).asc()]
    if tiebreak:
        cols.append(F.col(tiebreak).desc() if desc else F.col(tiebreak).asc())
    return cols


# ---------------------------------------------------------------- access layout of the job table
def store_jobs(df: DataFrame, path: str, status: str, key: str, lookups: list[str] | None = None) -> DataFrame:
    """Write a job table for point and status lookups (T7, T9, T10) and return it.

    Normalised statuses become the partitions, as column ``job_status``; in them rows
    are sorted by ``key``, so a key's rows lie in few row groups, and ``key`` and
    the ``lookups`` columns get Parquet bloom filters, by which a scan
    passes over row groups without the value. A large status is split over files by its size.
    """
    rows = df.withColumn("job_status", normalise_status(F.col(status)))
    writer = rows.hint("rebalance", F.col("job_status")).sortWithinPartitions("job_status", key).write.mode("overwrite").partitionBy("job_status")
    for c in [key, *(lookups or [])]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


# ---------------------------------------------------------------- T5 / T6
def most_recent(df: DataFrame, ts: str, n: int = 100, tiebreak: str | None = None) -> DataFrame:
    """The n newest rows (distributed top-n: each task keeps n, then one merge)."""
    return df.orderBy(*_order(ts, tiebreak)).limit(n)


def stable_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """n rows chosen by key order, so repeated runs return the same rows."""
    return df.orderBy(*[F.col(c).asc() for c in order]).limit(n)


# ---------------------------------------------------------------- T7-T10
def history_for(df: DataFrame, key: str, value, ts: str, tiebreak: str | None = None) -> DataFrame:
    """One key's rows, newest first (predicate reaches the scan)."""
    return df.filter(F.col(key) == F.lit(value)).orderBy(*_order(ts, tiebreak))


def latest_per_key(df: DataFrame, key: str, ts: str, n: int = 5, tiebreak: str | None = None) -> DataFrame:
    """Each key's n newest rows plus the key's total row count.

    The count is a separate keyed aggregate joined back on the key; both
    sides are at most n (resp. one) rows per key.
    """
    w = Window.partitionBy(key).orderBy(*_order(ts, tiebreak))
    top = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_total"))
    return top.join(counts, key)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup (pushed to the scan as an equality filter)."""
    return df.filter(F.col(key) == F.lit(value))


def by_status(df: DataFrame, status: str, value: str, ts: str, tiebreak: str | None = None, stored: bool = False) -> DataFrame:
    """Rows in one status, newest update first.

    ``stored`` says that the column holds normalised statuses, as ``store_jobs``
    and ``with_status_badge`` write them: then the plain comparison reaches the
    scan, and in the layout of ``store_jobs`` it reads that partition only.
    """
    current = F.col(status) if stored else normalise_status(F.col(status))
    return df.filter(current == F.lit(value.upper())).orderBy(*_order(ts, tiebreak))


# ---------------------------------------------------------------- W6
def latest_status(df: DataFrame, key: str, ts: str, status: str, tiebreak: str | None = None) -> DataFrame:
    """Latest status per key: ``max_by(status, (ts, tiebreak))`` — an aggregate,
    not a window, so no key's rows are gathered in one task."""
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return df.groupBy(key).agg(
        F.max_by(F.col(status), order).alias("latest_status"),
        F.max(F.col(ts)).alias("latest_ts"),
        F.count(F.lit(1)).alias("n_events"))


# ---------------------------------------------------------------- W7
def step_durations(df: DataFrame, key: str, ts: str, tiebreak: str | None = None, piece: str = "day") -> DataFrame:
    """Seconds from each row to the next row of the same key (NULL for the last).

    A key's rows are cut into pieces of time (``piece``: a unit of
    ``date_trunc``). Inside a piece a window finds the next row; a piece's last
    row takes the first time of the key's next piece, from a table of one row
    per key and piece. So no task holds all rows of a key. Rows without a
    key (e.g. log lines outside any run) are no sequence and are dropped.
    """
    rows = df.where(F.col(key).isNotNull()).withColumn("_piece", F.date_trunc(piece, F.col(ts).cast("timestamp")))
    inside = Window.partitionBy(key, "_piece").orderBy(*_order(ts, tiebreak, desc=False))
    rows = rows.withColumn("_next", F.lead(F.col(ts)).over(inside))
    firsts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), F.date_trunc(piece, F.col(ts).cast("timestamp")).alias("_at")).agg(F.min(ts).alias("_first"))
    firsts = firsts.withColumn("_follow", F.lead("_first").over(Window.partitionBy("_key").orderBy("_at"))).select("_key", "_at", "_follow")
    rows = rows.join(firsts, (F.col(key) == F.col("_key")) & F.col("_piece").eqNullSafe(F.col("_at")), "left")
    after = F.coalesce("_next", "_follow")
    micros = F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (micros / F.lit(1e6)).alias("duration_sec"))


# ---------------------------------------------------------------- X1-X3 batch form
def _bounds(window: str = "w") -> list[Column]:
    return [F.col(f"{window}.start").cast("timestamp_ntz").alias("window_start"), F.col(f"{window}.end").cast("timestamp_ntz").alias("window_end")]


def window_alarm(df: DataFrame, ts: str, condition: Column, width: str = "5 minutes",
                 keys: list[str] | None = None, name: str = "failures") -> DataFrame:
    """Tumbling windows with at least one row matching ``condition``.

    Only matching rows reach the aggregate; the condition can be pushed to the scan.
    """
    g = df.where(condition).groupBy(F.window(F.col(ts), width).alias("w"), *(keys or []))
    return g.agg(F.count(F.lit(1)).alias(name)).select(*_bounds(), *(keys or []), name)


def window_percentile(df: DataFrame, ts: str, value: str, p: float = 0.95, width: str = "5 minutes",
                      approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Per tumbling window: row count and the p-quantile of ``value``.

    Exact and interpolated (``quantiles.exact_quantiles``); ``approx=True``
    takes a bounded sketch's value instead.
    """
    rows = df.select(F.window(F.col(ts), width).alias("w"), F.col(value).alias("_value"))
    if approx:
        return rows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_value", F.lit(p), accuracy).alias("p95")).select(*_bounds(), "n", "p95")
    rows = rows.select(F.col("w.start").alias("_start"), F.col("w.end").alias("_end"), "_value")
    counts = rows.groupBy("_start", "_end").agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(rows, "_value", [p], by=["_start"]).select(F.col("_start").alias("_at"), F.col("q0").alias("p95"))
    return counts.join(q, counts["_start"] == q["_at"], "left").select(
        F.col("_start").cast("timestamp_ntz").alias("window_start"), F.col("_end").cast("timestamp_ntz").alias("window_end"), "n", "p95")


# ---------------------------------------------------------------- F12 / F13
def parse_run_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines -> (ts, level, run_id, message); banner lines are dropped."""
    fields = parse_log_line(F.col(column))
    return lines.select(*[c.alias(n) for n, c in fields.items()]).filter(F.col("ts").isNotNull())


def with_status_badge(df: DataFrame, status: str) -> DataFrame:
    return df.withColumns({"status_norm": normalise_status(F.col(status)),
                           "badge": status_badge(F.col(status))})
