"""Table sinks (S3, S4): processed-table writes and the "latest" snapshot.

Writes are the pipeline's durability points: a written table survives
executor loss and cuts lineage, so downstream reports re-scan Parquet
instead of re-running the joins and the de-duplication.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_COLUMNS = ("year",)


#: Files that a task of a write without rebalancing keeps open; with more partition values it sorts its rows instead.
OPEN_FILES = 32


def write_partitioned(df: DataFrame, path: str, partition_by=PARTITION_COLUMNS, mode: str = "overwrite", rebalance: bool = True,
                      codec: str | None = None) -> str:
    """Write Parquet partitioned by ``partition_by`` (default ``year``, the
    user-filter column, so a year filter prunes directories).

    The rows are rebalanced on the partition columns: adaptive execution
    measures the shuffled bytes, splits a hot year over as many tasks of
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` as it needs and joins
    small ones, so files follow the size of the data at any scale. Without
    ``rebalance`` nothing is shuffled: each task writes a file per partition value, which
    suits rows that are read from files in splits of an even size. ``codec`` compresses the files (default: the session's).
    """
    options = {"compression": codec} if codec else {}
    cols = [c for c in partition_by if c in df.columns]
    if rebalance or not cols:
        out = df.hint("rebalance", *[F.col(c) for c in cols]) if cols else df
        out.write.options(**options).mode(mode).partitionBy(*cols).parquet(path)
        return path
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, OPEN_FILES)
    try:
        df.write.options(**options).mode(mode).partitionBy(*cols).parquet(path)
    finally:
        conf.set(key, before)
    return path


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Re-scan a processed table; a ``year`` filter prunes directories."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header (the original processed-file format), one folder of parts."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def publish_latest(df: DataFrame, base: str, name: str = "latest", fmt: str = "parquet") -> str:
    """Publish a snapshot: a new version folder, then a pointer that names it.

    The version is written in full before the small pointer file is replaced
    by a rename, so a reader of the pointer finds the old or the new snapshot
    and never a half-written one. Older versions stay until they are removed.
    Returns the version's path.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    root = f"{base.rstrip('/')}/{name}"
    df.write.format(fmt).option("header", True).save(f"{root}/versions/{version}")
    fs, hadoop = _file_system(spark, root)
    fresh, pointer = hadoop.Path(f"{root}/.{version}.tmp"), hadoop.Path(f"{root}/CURRENT")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context = hadoop.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(fresh), context.makeQualified(pointer), options)
    return f"{root}/versions/{version}"


def read_latest(spark: SparkSession, base: str, name: str = "latest", fmt: str = "parquet") -> DataFrame:
    """The snapshot that the pointer names."""
    root = f"{base.rstrip('/')}/{name}"
    version = spark.read.text(f"{root}/CURRENT").first()["value"]
    return spark.read.format(fmt).option("header", True).load(f"{root}/versions/{version}")
