"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import FREE_SHUFFLES, freed_shuffles, scratch_path  # noqa: F401  (FREE_SHUFFLES)
from ..sources.testdata import table

#: A side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python once per application, so that
    functions of its modules can be loaded there wherever it is installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Later stages start from the files, so a lost executor costs no more than
    the tasks that read them, and values that depend on the run (partition
    ids, file order) are fixed once written. The write's shuffles are deleted
    with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    with freed_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables that `cut` has written, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast when ``rows`` (counted, not estimated) prove it small."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each
    (one row at least), so a run of long texts doesn't fill a worker."""
    for batch in batches:
        start, held = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            held += (n or 0) + 16
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
