"""Structured Streaming jobs equal their batch forms."""

import os

import pytest
from pyspark.sql import functions as F

from tillgrid.operators import jobs, metrics
from tillgrid.plans.prepare import prepare
from tillgrid.sources.files import read_upload_files as files_read
from tillgrid.sources.testdata import sales_view, table
from tillgrid.streaming import alarms, uploads
from oracle_harness import SF_SMALL


def _run(query):
    query.processAllAvailable()
    query.stop()


def test_failure_alarm_stream_equals_batch_on_closed_windows(spark, tmp):
    ev = table(spark, SF_SMALL, "events")
    src = os.path.join(tmp, "events")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = (alarms.failure_alarm(stream, F.col("event_type") == "error").writeStream
         .format("memory").queryName("x1_out").outputMode("append")
         .option("checkpointLocation", os.path.join(tmp, "ck")).trigger(availableNow=True).start())
    _run(q)
    got = {(str(r["window_start"]), r["failures"]) for r in spark.table("x1_out").collect()}
    batch = jobs.window_alarm(ev, "ts", F.col("event_type") == "error")
    max_ts = ev.agg(F.max("ts")).first()[0]
    closed = batch.filter(F.col("window_end") <= F.lit(max_ts) - F.expr("INTERVAL 10 MINUTES"))
    want = {(str(r["window_start"]), r["failures"]) for r in closed.collect()}
    assert want and want <= got
    assert len(got - want) <= 2  # windows closed between the last two watermarks


def test_status_timeline_stream(spark, tmp):
    ev = table(spark, SF_SMALL, "events")
    src = os.path.join(tmp, "events")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = (alarms.status_timeline(stream, "user_id", "ts", "event_type", "event_id").writeStream
         .format("memory").queryName("x4_out").outputMode("complete")
         .option("checkpointLocation", os.path.join(tmp, "ck")).trigger(availableNow=True).start())
    _run(q)
    got = {r["user_id"]: r["latest_status"] for r in spark.table("x4_out").collect()}
    want = {r["user_id"]: r["latest_status"] for r in jobs.latest_status(ev, "user_id", "ts", "event_type", "event_id").collect()}
    assert got == want


def test_p95_stream_equals_batch(spark, tmp):
    ev = table(spark, SF_SMALL, "events")
    src = os.path.join(tmp, "events")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = (alarms.duration_p95(stream, "value").writeStream.format("memory").queryName("x3_out")
         .outputMode("complete").option("checkpointLocation", os.path.join(tmp, "ck"))
         .trigger(availableNow=True).start())
    _run(q)
    got = {str(r["window_start"]): (r["n"], round(r["p95"], 6)) for r in spark.table("x3_out").collect()}
    want = {str(r["window_start"]): (r["n"], round(r["p95"], 6)) for r in jobs.window_percentile(ev, "ts", "value").collect()}
    assert got == want


def _upload(tmp, job, df, name, columns=None):
    """One file of an upload, with its own column order."""
    path = os.path.join(tmp, "landing", job)
    os.makedirs(path, exist_ok=True)
    (df.select(columns) if columns else df).toPandas().to_csv(os.path.join(path, name), index=False)
    return path


def _rows(df):
    return sorted(str(tuple(str(r[c]) for c in sorted(df.columns))) for r in df.collect())


def _expected(spark, tmp, job):
    from tillgrid.sources.files import read_sales_csv

    return prepare(read_sales_csv(spark, os.path.join(tmp, "landing", job)))


def test_status_table_rewrites_touched_buckets_only(spark, tmp):
    """A trigger with one job replaces one bucket; replays and later triggers give the timeline of all events."""
    src, out, progress = (os.path.join(tmp, x) for x in ("events", "status", "progress"))
    ev = table(spark, SF_SMALL, "events").select("event_id", "user_id", "ts", "event_type")

    def files():
        return {b: sorted(os.listdir(os.path.join(out, b))) for b in os.listdir(out) if b.startswith("bucket=")}

    def trigger(events):
        events.write.mode("append").parquet(src)
        stream = spark.readStream.schema(ev.schema).parquet(src)
        alarms.status_table(stream, out, progress, "user_id", "ts", "event_type", "event_id", buckets=8).awaitTermination(200)
        seen = spark.read.parquet(src)
        expected = alarms.status_timeline(seen, "user_id", "ts", "event_type", "event_id")
        assert _rows(spark.read.parquet(out).drop("bucket")) == _rows(expected)

    trigger(ev.where("event_id % 2 = 0"))
    before = files()
    assert len(before) == 8
    trigger(ev.where("event_id % 2 = 1 and user_id = 7"))
    after = files()
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1
    one = spark.read.parquet(out).where("user_id = 7").drop("bucket")
    alarms.upsert_by_key(spark.createDataFrame(one.collect(), one.schema), out, "user_id", buckets=8)  # the same rows again
    assert _rows(spark.read.parquet(out).drop("bucket")) == _rows(alarms.status_timeline(spark.read.parquet(src), "user_id", "ts", "event_type", "event_id"))
    assert [b for b in after if files()[b] != after[b]] == changed


def test_uploads_are_processed_per_job(spark, tmp):
    """Several files and column orders per upload, one file a trigger: as one batch run; a replay changes nothing."""
    sv = sales_view(spark, SF_SMALL).where("day(date) % 5 = 0")
    half = sv.filter(F.col("region") == "ASIA"), sv.filter(F.col("region") == "EUROPE")
    _upload(tmp, "job-a", half[0], "1.csv")
    _upload(tmp, "job-a", half[0], "2.csv", sorted(sv.columns))  # the same rows again: de-duplicated across files
    _upload(tmp, "job-b", half[1], "1.csv", sorted(sv.columns, reverse=True))
    landing, out, rolled = (os.path.join(tmp, x) for x in ("landing", "out", "rollups"))
    for again in range(2):
        uploads.process_uploads(spark, landing, out, os.path.join(tmp, "ck"), rolled, max_files_per_trigger=1).awaitTermination(300)
        res = spark.read.parquet(out)
        for job in ("job-a", "job-b"):
            own = res.where(F.col("job_id") == job).drop("job_id")
            assert _rows(own) == _rows(_expected(spark, tmp, job).select(own.columns))
        if not again:
            _upload(tmp, "job-b", half[0], "3.csv")  # late file of a known upload
    before = _rows(res)
    uploads.refresh_jobs(spark, landing, out, rolled, ["job-a"])  # a replayed batch
    assert _rows(spark.read.parquet(out)) == before

    total = uploads.sales_rollup(spark.read.parquet(rolled))
    assert _rows(total) == _rows(uploads.rollup(spark.read.parquet(out)).select(total.columns))
    cube = metrics.sales_cube(spark.read.parquet(out)).where("grain = 'all'").first()
    sums = total.agg(F.sum("total_units"), F.sum("n_units"), F.sum("n_rows")).first()
    assert (float(sums[0]), sums[1], sums[2]) == (float(cube["total_units"]), cube["n_units"], cube["n_rows"])


def test_a_late_file_is_the_only_one_read(spark, tmp, monkeypatch):
    """CSV text is read once per file; a replaced file starts its upload anew; every state equals one batch run."""
    read = []
    monkeypatch.setattr(uploads, "read_upload_files", lambda s, files, **more: (read.append(sorted(os.path.basename(f) for f in files)), files_read(s, files, **more))[1])
    sv = sales_view(spark, SF_SMALL).where("day(date) % 9 = 0")
    parts = [sv.filter(F.col("region") == r) for r in ("ASIA", "EUROPE", "AFRICA")]
    landing, out, rolled = (os.path.join(tmp, x) for x in ("landing", "out", "rollups"))

    def check():
        uploads.refresh_jobs(spark, landing, out, rolled, ["job-a"])
        own = spark.read.parquet(out).where("job_id = 'job-a'").drop("job_id")
        assert _rows(own) == _rows(_expected(spark, tmp, "job-a").select(own.columns))
        assert _rows(uploads.sales_rollup(spark.read.parquet(rolled))) == _rows(uploads.rollup(spark.read.parquet(out)))

    _upload(tmp, "job-a", parts[0], "1.csv")
    check()
    _upload(tmp, "job-a", parts[0].unionByName(parts[1]), "2.csv", sorted(sv.columns))  # repeats the first file
    check()
    check()  # nothing new: no CSV is read
    assert read == [["1.csv"], ["2.csv"]]
    _upload(tmp, "job-a", parts[2].limit(50), "1.csv")  # replaced: its old rows go, but for those the second file repeats
    check()
    assert read[2:] == [["1.csv", "2.csv"]]
    assert {r["part"] for r in spark.read.parquet(f"{out}-state/ledger").collect()}.__len__() == 1


def test_upload_without_a_column_fails(spark, tmp):
    path = os.path.join(tmp, "landing", "job-c")
    os.makedirs(path)
    with open(os.path.join(path, "x.csv"), "w") as fh:
        fh.write("date,price\n2024-01-01,2\n")
    with pytest.raises(ValueError, match="Missing required columns"):
        uploads.refresh_jobs(spark, os.path.join(tmp, "landing"), os.path.join(tmp, "out"), None, ["job-c"])
