"""File scans.

Uploaded sales files are read with every column as STRING (no inference
pass over the data, no type guessed from the first rows); typing happens in
the cleaning plan with ``try_`` casts, so a bad cell becomes NULL instead of
failing the job.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.clean import normalise_headers, null_na_tokens

# --- fixed values: JSON payload contracts ---
START_JOB_SCHEMA = StructType([StructField(n, StringType()) for n in (
    "job_id", "user_id", "filename", "operation", "description", "s3_input_key", "created_at")])
STATUS_EVENT_SCHEMA = StructType([StructField(n, StringType()) for n in (
    "job_id", "status", "stage", "message", "updated_at")])

# Column that holds the text of records whose cells don't fit the header.
MALFORMED = "_malformed"


def _csv_reader(spark: SparkSession, sep: str = ",", quote: str = '"', header: bool = True, multi_line: bool = False):
    return (spark.read.option("header", header).option("sep", sep).option("quote", quote).option("multiLine", multi_line)
            .option("escape", quote).option("inferSchema", False).option("mode", "PERMISSIVE"))


def _parent_folder() -> Column:
    """Name of the folder of the row's file; file metadata holds paths with escapes."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)


def _first_line(spark: SparkSession, file: str) -> str | None:
    """The first line of a (possibly compressed) text file, of which no more is read; None if it has none."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    path = hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        text = hadoop.io.Text()
        read = hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream, conf).readLine(text)
        return text.toString().removeprefix("\ufeff") if read else None
    finally:
        stream.close()


def header_groups(spark: SparkSession, path) -> list[tuple[str, list[str]]]:
    """(header line, files with it), from the first line of every file.

    No more than that line's block is read of a file, and no job scans the
    text; what reaches the driver is the list of files, as in any file listing.
    """
    groups: dict[str, list[str]] = {}
    for file in sorted(spark.read.text(path).inputFiles()):
        head = _first_line(spark, unquote(file))
        if head is not None:
            groups.setdefault(head.rstrip("\r"), []).append(unquote(file))
    return sorted(groups.items(), key=lambda g: g[1][0])


def _malformed(df: DataFrame, reader, files: list[str]) -> DataFrame:
    """The same files read with a column that holds the text of records with too few or too many cells."""
    schema = StructType([StructField(c, StringType()) for c in [*df.columns, MALFORMED]])
    return reader.schema(schema).option("columnNameOfCorruptRecord", MALFORMED).csv(files)


def _read_by_header(spark: SparkSession, path, sep: str, quote: str, multi_line: bool, job_id: bool = False,
                    malformed: bool = False) -> DataFrame:
    """Files of one header as they are; files of several headers each by their
    own names, normalised, and joined by name. A file without a column that
    the others have is an error that names it."""
    groups = header_groups(spark, path)
    if not groups:
        raise ValueError(f"no rows in {path}")
    frames = []
    for _, files in groups:
        reader = _csv_reader(spark, sep, quote, True, multi_line)
        df = reader.csv(files)
        df = _malformed(df, reader, files) if malformed else df
        if job_id:
            df = df.withColumn("job_id", _parent_folder())
        frames.append((normalise_headers(df) if len(groups) > 1 else df, files))
    columns = list(dict.fromkeys(c for df, _ in frames for c in df.columns))
    for df, files in frames:
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"Missing required columns: {missing} in {files[0]}")
    out = frames[0][0]
    for df, _ in frames[1:]:
        out = out.unionByName(df)
    return out


# ---------------------------------------------------------------- S1
def read_sales_csv(spark: SparkSession, path, sep: str = ",", quote: str = '"', header: bool = True,
                   na_tokens: list[str] | None = None, multi_line: bool = False, malformed: bool = False) -> DataFrame:
    """Uploaded CSV(s) -> all-STRING DataFrame with missing-value tokens as NULL.

    ``path`` may be one path, a glob or a list; each file's columns are those
    of its own header. Splitting is per file block, so a large upload is read
    by many tasks; ``multi_line`` reads a file per task instead, for cells
    that hold line breaks. ``malformed`` adds a column with the text of
    records whose cells don't fit the header (else NULL), to be counted.
    """
    if header:
        df = _read_by_header(spark, path, sep, quote, multi_line, malformed=malformed)
    else:
        df = _csv_reader(spark, sep, quote, False, multi_line).csv(path)
    return null_na_tokens(df, na_tokens)


# ---------------------------------------------------------------- S4 raw copy
def copy_raw(spark: SparkSession, src: str, dest: str) -> str:
    """Copy an uploaded text file line by line into the raw area (distributed)."""
    spark.read.text(src).write.mode("overwrite").text(dest)
    return dest


# ---------------------------------------------------------------- S5
def read_landing(spark: SparkSession, base: str, sep: str = ",", header: bool = True,
                 jobs: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Landing zone ``<base>/<job_id>/<file>.csv`` -> rows tagged with ``job_id``
    (the parent folder of each file, taken from the file metadata column).
    Each file is read by its own header; ``jobs`` limits the scan to those uploads."""
    root = base.rstrip("/")
    paths = [f"{root}/{j}/" for j in jobs] if jobs is not None else f"{root}/*/"
    if header:
        return null_na_tokens(_read_by_header(spark, paths, sep, '"', multi_line, job_id=True))
    df = _csv_reader(spark, sep, '"', False, multi_line).csv(paths)
    return null_na_tokens(df).withColumn("job_id", _parent_folder())


def read_upload_files(spark: SparkSession, files: list[str], sep: str = ",", multi_line: bool = False) -> DataFrame:
    """These files of a landing zone, each by its own header: ``job_id`` and the normalised columns."""
    return null_na_tokens(normalise_headers(_read_by_header(spark, files, sep, '"', multi_line, job_id=True)))


# ---------------------------------------------------------------- S6
def crawl_to_parquet(spark: SparkSession, src: str, dest: str, sep: str = ",", table: str | None = None) -> DataFrame:
    """Discover a CSV's schema (one inference pass), write it as Parquet, return the table.

    With ``table`` the files are registered under that name in the session's
    catalog, so later queries find them by name.
    """
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(src)
    if table is None:
        df.write.mode("overwrite").parquet(dest)
        return spark.read.parquet(dest)
    df.write.mode("overwrite").option("path", dest).format("parquet").saveAsTable(table)
    return spark.table(table)


# ---------------------------------------------------------------- S7
def manifest_options(manifest: dict) -> tuple[list[str], dict]:
    """Manifest document -> (URI prefixes, CSV reader options)."""
    prefixes = [p for loc in manifest.get("fileLocations", []) for p in loc.get("URIPrefixes", [])]
    settings = manifest.get("globalUploadSettings", {})
    opts = {
        "sep": settings.get("delimiter", ","),
        "quote": settings.get("textqualifier", '"'),
        "header": str(settings.get("containsHeader", "true")).lower() == "true",
    }
    fmt = settings.get("format", "CSV").upper()
    if fmt != "CSV":
        raise ValueError(f"unsupported manifest format {fmt}")
    return prefixes, opts


def read_manifest(spark: SparkSession, manifest_path: str) -> DataFrame:
    """Scan every prefix listed in a manifest file with its CSV dialect.

    The manifest is a small configuration document, read through Spark from
    whatever store its path names; the data it points to is read by the cluster.
    """
    text = spark.read.option("wholetext", True).text(manifest_path).first()["value"]
    prefixes, opts = manifest_options(json.loads(text))
    return read_sales_csv(spark, prefixes, sep=opts["sep"], quote=opts["quote"], header=opts["header"])


# ---------------------------------------------------------------- S8
def read_payloads(spark: SparkSession, path: str, schema: StructType = START_JOB_SCHEMA,
                  multiline: bool = True) -> DataFrame:
    """JSON payload documents with an explicit schema (no inference)."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def parse_payload_column(df: DataFrame, column: str, schema: StructType = STATUS_EVENT_SCHEMA,
                         alias: str = "payload") -> DataFrame:
    """JSON text column -> struct column (malformed text -> NULL struct fields)."""
    return df.withColumn(alias, F.from_json(F.col(column), schema))


def payload_times(df: DataFrame, columns: list[str]) -> DataFrame:
    """ISO-8601 text timestamps (``2026-03-10T09:30:00Z``) -> TIMESTAMP."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ssX")) for c in columns})
