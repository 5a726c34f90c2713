"""Operational alarms and status timelines on Structured Streaming.

Event time is ``ts``; a watermark bounds state (windows older than the
watermark are finalised and dropped; later rows are ignored). Event-time
columns must be TIMESTAMP (not TIMESTAMP_NTZ) for ``withWatermark``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Buckets of the status table: a trigger rewrites those of the jobs it has heard of.
STATUS_BUCKETS = 64


def with_event_time(stream: DataFrame, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def failure_alarm(stream: DataFrame, condition: Column, ts: str = "ts", width: str = "5 minutes",
                  watermark: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Windows (optionally per key) with at least one failure.

    Append mode emits each window once, after the watermark passes its end.
    Healthy rows move the watermark but leave no state.
    """
    s = with_event_time(stream, ts, watermark)
    # Written so that it isn't moved below the watermark, which healthy rows must still advance.
    s = s.where(F.when(condition, F.col(ts)).isNotNull())
    g = s.groupBy(F.window(F.col(ts), width).alias("w"), *(keys or []))
    return (g.agg(F.count(F.lit(1)).alias("failures"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *(keys or []), "failures"))


def duration_p95(stream: DataFrame, value: str, ts: str = "ts", width: str = "5 minutes",
                 watermark: str = "10 minutes", approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Per-window p95, interpolated as in the batch form.

    State holds a window's distinct values until the watermark passes it;
    ``approx=True`` keeps a sketch of fixed size instead.
    """
    s = with_event_time(stream, ts, watermark)
    g = s.groupBy(F.window(F.col(ts), width).alias("w"))
    p95 = F.percentile_approx(F.col(value), F.lit(0.95), accuracy) if approx else F.percentile(F.col(value), F.lit(0.95))
    return g.agg(F.count(F.lit(1)).alias("n"), p95.alias("p95")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "p95")


def status_timeline(stream: DataFrame, key: str = "job_id", ts: str = "updated_at",
                    status: str = "status", tiebreak: str | None = None) -> DataFrame:
    """Latest status per job while events arrive (update or complete mode).

    ``max_by`` keeps one small buffer per job in the state store, whatever
    the order in which events arrive.
    """
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return stream.groupBy(key).agg(F.max_by(F.col(status), order).alias("latest_status"),
                                   F.max(F.col(ts)).alias("updated_at"),
                                   F.count(F.lit(1)).alias("n_events"))


def upsert_by_key(batch: DataFrame, path: str, key: str, buckets: int = STATUS_BUCKETS) -> None:
    """Put the rows of ``batch`` (one per key) in place of the keys' rows in the table at ``path``.

    Keys are dealt into ``buckets`` folders by hash; only the folders of the batch's keys
    are read and replaced. A batch that is replayed gives the same table.
    """
    spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = batch.withColumn("bucket", bucket).persist()
    try:
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most all buckets
        if not touched:
            return
        merged, target = rows, spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            held = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched))
            merged = held.join(rows.select(key), key, "left_anti").unionByName(rows)
        (merged.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(path))
    finally:
        rows.unpersist()


def status_table(stream: DataFrame, path: str, checkpoint: str, key: str = "job_id", ts: str = "updated_at", status: str = "status",
                 tiebreak: str | None = None, buckets: int = STATUS_BUCKETS, available_now: bool = True) -> StreamingQuery:
    """X4 as a table: the status timeline in update mode, so a trigger writes the jobs that changed and no others."""
    timeline = status_timeline(stream, key, ts, status, tiebreak)
    writer = (timeline.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, _: upsert_by_key(batch, path, key, buckets)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
