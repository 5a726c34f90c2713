"""Upload-triggered processing and incremental rollups.

New files dropped under ``<landing>/<job_id>/`` are noticed by a file stream
that reads their names only. Beside the processed table lies a state folder:

* ``cleaned``: per batch of files the rows they added to their uploads, de-duplicated against the
  uploads' earlier files and cleaned, with a 128-bit hash of the raw row. Written once.
* ``ledger``: per upload its files (path, length, time) with the name of their batch's part.

A micro-batch reads the CSV text of files that the ledger doesn't know, and of no others.
The fence is taken anew over one column of the upload's cleaned parts, and the
upload's partitions of the processed table and of the rollup are replaced from
these parts. A file that was replaced or removed starts its upload anew. The ledger is
written after the parts it names, and parts that it doesn't name are never read, so an upload that
arrives over several micro-batches, or a batch that is replayed after a
failure, ends with the same rows as one batch run. Progress lives in the
checkpoint folder; ``trigger(availableNow=True)`` processes what is there
and stops.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean, quality
from ..sources.files import read_upload_files

LEDGER = "path string, length long, modified long, part string, columns string, job_id string"
#: Columns of a cleaned part that the processed table doesn't have.
ROW_HASHES = ("_row1", "_row2")


def landing_files(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the new files under ``<landing>/<job_id>/``: ``path``, ``job_id`` (contents aren't read)."""
    reader = (spark.readStream.format("binaryFile").option("pathGlobFilter", "[!_.]*")
              .schema("path string, modificationTime timestamp, length long, content binary"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(f"{landing.rstrip('/')}/*/")
    return files.select("path", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("job_id"))


def row_clean(df: DataFrame) -> DataFrame:
    """Per-row cleaning: names, required columns, dates, numbers, drops."""
    out = quality.check_schema(clean.normalise_headers(df))
    out = clean.drop_missing(clean.parse_dates(out, "date"), ["date"])
    out = clean.drop_missing(clean.coerce_numeric(out), ["units_sold"])
    return out


def row_hashes(columns: list[str]) -> tuple[Column, Column]:
    """128 bits of hash over the raw cells by column name; a missing cell counts as a cell of its own kind."""
    names = sorted(columns)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    missing = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in names])
    return F.xxhash64(missing, *cells), F.xxhash64(F.lit("second"), *cells, missing)


def prepare_by_job(cleaned: DataFrame, key: str = "job_id") -> DataFrame:
    """Fence and features of cleaned rows that hold several uploads, one fence per upload."""
    out = clean.outlier_fence(cleaned, "units_sold", by=[key])
    return clean.fill_discount(clean.add_features(out))


ROLLUP_KEYS = ["year", "month", "category", "region"]


def rollup(processed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums and counts per (year, month, category, region), so any mean or coarser total is exact."""
    revenue = F.col("units_sold").cast("decimal(38,6)") * F.col("price").cast("decimal(38,6)")
    return processed.groupBy(*(keys or []), *ROLLUP_KEYS).agg(
        F.sum(F.col("units_sold").cast("decimal(38,6)")).alias("total_units"), F.count("units_sold").alias("n_units"),
        F.sum(revenue.cast("decimal(38,6)")).alias("total_revenue"), F.count(F.lit(1)).alias("n_rows"))


def replace_jobs(df: DataFrame, path: str) -> None:
    """Write the rows of each ``job_id`` in ``df`` in place of what ``path`` holds of it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


@dataclass(frozen=True)
class UploadFile:
    """A file of an upload, and the part with its cleaned rows once it has one."""

    job_id: str
    path: str
    length: int
    modified: int
    part: str = ""
    columns: str = ""

    def same_as(self, other: UploadFile) -> bool:
        return (self.path, self.length, self.modified) == (other.path, other.length, other.modified)


def listed_files(spark: SparkSession, landing: str, jobs: list[str]) -> list[UploadFile]:
    """The files that these uploads hold now (names and sizes only)."""
    hadoop, conf, out = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), []
    for job in jobs:
        folder = hadoop.Path(f"{landing.rstrip('/')}/{job}")
        for s in folder.getFileSystem(conf).listStatus(folder):
            if s.isFile() and s.getPath().getName()[0] not in "_.":
                out.append(UploadFile(job, s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return out


def _stored(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def known_files(spark: SparkSession, state: str, jobs: list[str]) -> list[UploadFile]:
    """The ledger's files of these uploads."""
    if not _stored(spark, f"{state}/ledger"):
        return []
    rows = spark.read.schema(LEDGER).parquet(f"{state}/ledger").where(F.col("job_id").isin(jobs)).collect()  # a row per file of these uploads
    return [UploadFile(r["job_id"], r["path"], r["length"], r["modified"], r["part"], r["columns"]) for r in rows]


def cleaned_parts(spark: SparkSession, state: str, files: list[UploadFile]) -> DataFrame:
    """The cleaned rows of these files."""
    jobs, parts = (sorted({getattr(f, name) for f in files}) for name in ("job_id", "part"))
    return spark.read.parquet(f"{state}/cleaned").where(F.col("job_id").isin(jobs) & F.col("part").isin(parts))  # folders of the table


def add_files(spark: SparkSession, state: str, fresh: list[UploadFile], kept: list[UploadFile]) -> list[UploadFile]:
    """Read and clean the ``fresh`` files, write the rows that their uploads don't have from ``kept`` files yet, as one part."""
    tag = uuid.uuid4().hex
    raw = read_upload_files(spark, [f.path for f in fresh])
    cells = [c for c in raw.columns if c != "job_id"]
    names = ",".join(sorted(cells))
    for f in kept:
        if f.columns != names:
            differing = sorted(set(f.columns.split(",")) ^ set(cells))
            raise ValueError(f"Missing required columns: {differing} in {fresh[0].path} or {f.path}")
    one, two = row_hashes(cells)
    rows = raw.select("*", one.alias("_row1"), two.alias("_row2")).dropDuplicates(["job_id", "_row1", "_row2"])
    if any(f.part for f in kept) and _stored(spark, f"{state}/cleaned"):
        rows = rows.join(cleaned_parts(spark, state, kept).select("job_id", "_row1", "_row2"), ["job_id", "_row1", "_row2"], "left_anti")
    out = row_clean(rows).withColumn("part", F.lit(tag))
    out.write.mode("append").partitionBy("job_id", "part").parquet(f"{state}/cleaned")
    return [UploadFile(f.job_id, f.path, f.length, f.modified, tag, names) for f in fresh]


def refresh_jobs(spark: SparkSession, landing: str, output: str, rollups: str | None, jobs: list[str], state: str | None = None) -> None:
    """Bring these uploads up to date: clean their new files, then replace their partitions of ``output`` and ``rollups``."""
    state = state or f"{output.rstrip('/')}-state"
    now, known = listed_files(spark, landing, jobs), known_files(spark, state, jobs)
    lost = {k.job_id for k in known if not any(k.same_as(f) for f in now)}  # replaced or removed files: these uploads start anew
    kept = [k for k in known if k.job_id not in lost]
    fresh = [f for f in now if not any(k.same_as(f) for k in kept)]
    files = kept + (add_files(spark, state, fresh, kept) if fresh else [])
    if not files:
        return
    if fresh or lost:
        ledger = spark.createDataFrame([(f.path, f.length, f.modified, f.part, f.columns, f.job_id) for f in files], LEDGER)
        replace_jobs(ledger.coalesce(1), f"{state}/ledger")
    prepared = prepare_by_job(cleaned_parts(spark, state, files).drop("part", *ROW_HASHES))
    replace_jobs(prepared, output)
    if rollups:
        done = spark.read.schema(prepared.schema).parquet(output).where(F.col("job_id").isin(jobs))
        replace_jobs(rollup(done, ["job_id"]), rollups)


def process_uploads(spark: SparkSession, landing: str, output: str, checkpoint: str, rollups: str | None = None,
                    max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Run the pipeline for every upload with new files and replace its rows in ``output`` (and in ``rollups``)."""

    def handle(batch: DataFrame, epoch_id: int) -> None:
        jobs = sorted(r["job_id"] for r in batch.select("job_id").distinct().collect())  # the uploads of one trigger
        if jobs:
            refresh_jobs(batch.sparkSession, landing, output, rollups, jobs)

    writer = (landing_files(spark, landing, max_files_per_trigger).writeStream
              .foreachBatch(handle).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def sales_rollup(rollups: DataFrame) -> DataFrame:
    """The running totals over all uploads, from the per-upload rollup of processed rows."""
    return rollups.groupBy(*ROLLUP_KEYS).agg(*[F.sum(c).alias(c) for c in ("total_units", "n_units", "total_revenue", "n_rows")])
