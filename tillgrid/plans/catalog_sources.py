"""Query registrations: sources, sinks, uploads and whole reports.

Each query writes the driver's tables out in the form an upload has (CSV files
with their own headers, a manifest, payload documents), under the shared
folder, and reads them back through the library.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clean
from ..session import scratch_path
from ..sources import files, ingest, sinks
from ..sources.testdata import sales_view, table
from ..streaming import alarms, uploads
from . import reports
from .catalog import PROCESSED_CTE, processed, register, sql
from .catalog_reports import FORECAST_LINES, REPORT_SQL, lines_sql, markdown_sql
from .prepare import prepare

SUMMARY = """SELECT region, COUNT(*) AS n_rows, SUM(units_sold) AS total_units, MIN(date) AS first_date, MAX(date) AS last_date
FROM processed GROUP BY region"""


def _summary(df):
    return df.groupBy("region").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("units_sold").alias("total_units"),
                                    F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def _folder(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _uploads(spark, sf_dir, sep=","):
    """The sales view as two CSV uploads: other column orders, untidy headers, other missing-value tokens."""
    s, path = sales_view(spark, sf_dir), _folder(spark, "uploads")
    tidy = s.where("region <> 'ASIA'")
    messy = s.where("region = 'ASIA'").select(*[F.col(c).alias(f" {c.replace('_', ' ').title()} ") for c in reversed(s.columns)])
    for name, df in (("tidy", tidy), ("messy", messy)):
        df.write.option("header", True).option("sep", sep).option("nullValue", "N/A").csv(f"{path}/{name}")
    return [f"{path}/tidy", f"{path}/messy"]


# ================================================================== S1 / S3
@register("csv_uploads", sql(SUMMARY))
def q_csv_uploads(spark, sf_dir):
    return _summary(prepare(files.read_sales_csv(spark, _uploads(spark, sf_dir)), cleaned_path=_folder(spark, "cleaned")))


# ================================================================== S7
@register("manifest_scan", sql(SUMMARY))
def q_manifest_scan(spark, sf_dir):
    paths, manifest = _uploads(spark, sf_dir, ";"), _folder(spark, "manifest")
    text = F.to_json(F.struct(F.array(F.struct(F.array(*[F.lit(p) for p in paths]).alias("URIPrefixes"))).alias("fileLocations"),
                              F.struct(F.lit("CSV").alias("format"), F.lit(";").alias("delimiter"), F.lit("true").alias("containsHeader")).alias("globalUploadSettings")))
    spark.range(1).select(text.alias("value")).coalesce(1).write.text(manifest)
    return _summary(prepare(files.read_manifest(spark, manifest), cleaned_path=_folder(spark, "cleaned")))


# ================================================================== S5 / S9 / X5
def _landing(spark, sf_dir):
    """One upload per region, as CSV files under its folder."""
    path = _folder(spark, "landing")
    s = sales_view(spark, sf_dir)
    s.withColumn("upload", F.lower("region")).write.partitionBy("upload").option("header", True).csv(path)
    return path


@register("landing_scan", f"""
WITH sales AS ({PROCESSED_CTE.split("WITH sales AS (", 1)[1].split("),\ndedup AS", 1)[0]})
SELECT 'upload=' || lower(region) AS job_id, COUNT(*) AS n_rows, SUM(units_sold) AS total_units FROM sales GROUP BY 1""")
def q_landing_scan(spark, sf_dir):
    rows = files.read_landing(spark, _landing(spark, sf_dir))
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("units_sold").cast("double")).alias("total_units"))


PER_UPLOAD = PROCESSED_CTE.replace(
    "quart AS (SELECT quantile_cont", "quart AS (SELECT region AS r, quantile_cont").replace("AS q3 FROM cleaned)", "AS q3 FROM cleaned GROUP BY region)").replace(
    "bounds AS (SELECT q1", "bounds AS (SELECT r, q1").replace("WHERE c.units_sold >=", "WHERE c.region = b.r AND c.units_sold >=")


def _processed_uploads(spark, sf_dir):
    landing, out, rolled, checkpoint = _landing(spark, sf_dir), *(_folder(spark, x) for x in ("job-rows", "job-rollups", "job-progress"))
    uploads.process_uploads(spark, landing, out, checkpoint, rolled).awaitTermination()
    return out, rolled


@register("uploads_processed", PER_UPLOAD + """SELECT 'upload=' || lower(region) AS job_id, COUNT(*) AS n_rows, SUM(units_sold) AS total_units,
       SUM(promotion_flag) AS promotions FROM processed GROUP BY 1""")
def q_uploads_processed(spark, sf_dir):
    rows = spark.read.parquet(_processed_uploads(spark, sf_dir)[0])
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("units_sold").alias("total_units"),
                                                                  F.sum("promotion_flag").alias("promotions"))


@register("upload_rollup", PER_UPLOAD + """SELECT year, month, category, region, SUM(units_sold) AS total_units, COUNT(units_sold) AS n_units,
       CAST(SUM(CAST(units_sold AS DECIMAL(18,6)) * CAST(price AS DECIMAL(18,6))) AS DOUBLE) AS total_revenue, COUNT(*) AS n_rows
FROM processed GROUP BY year, month, category, region""")
def q_upload_rollup(spark, sf_dir):
    total = uploads.sales_rollup(spark.read.parquet(_processed_uploads(spark, sf_dir)[1]))
    return total.withColumns({c: F.col(c).cast("double") for c in ("total_units", "total_revenue")})


# ================================================================== S4
@register("latest_snapshot", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def q_latest_snapshot(spark, sf_dir):
    base, c = _folder(spark, "published"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    sinks.publish_latest(c.where("c_custkey % 2 = 0"), base)
    sinks.publish_latest(c, base)
    return sinks.read_latest(spark, base)


# ================================================================== S6
@register("crawled_table", "SELECT p_brand, COUNT(*) AS n_parts, SUM(p_size) AS total_size FROM part GROUP BY p_brand")
def q_crawled_table(spark, sf_dir):
    raw, dest = _folder(spark, "raw-part"), _folder(spark, "crawled-part")
    table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").write.option("header", True).csv(raw)
    return files.crawl_to_parquet(spark, raw, dest).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("p_size").alias("total_size"))


# ================================================================== S6 + C1
@register("ingested_sales", sql(SUMMARY))
def q_ingested_sales(spark, sf_dir):
    """The cleaning pipeline over facts and orders that were ingested in buckets of the order key."""
    facts = ingest.ingest_facts(spark, table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    return _summary(prepare(sales_view(spark, sf_dir, facts, distinct=True), cleaned_path=_folder(spark, "cleaned"), distinct=True))


# ================================================================== S8
@register("payload_events", """
SELECT event_type AS status, COUNT(*) AS n, date_trunc('second', MAX(ts)) AS last_update, COUNT(DISTINCT user_id) AS n_jobs
FROM events GROUP BY event_type""")
def q_payload_events(spark, sf_dir):
    path = _folder(spark, "payloads")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    doc = F.to_json(F.struct(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.lit("ETL").alias("stage"),
                             F.lit("m").alias("message"), stamp.alias("updated_at")))
    table(spark, sf_dir, "events").select(doc.alias("value")).write.text(path)
    rows = files.payload_times(files.read_payloads(spark, path, files.STATUS_EVENT_SCHEMA, multiline=False), ["updated_at"])
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").cast("timestamp_ntz").alias("last_update"),
                                      F.countDistinct("job_id").alias("n_jobs"))


# ================================================================== X4
@register("status_timeline", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest_status, MAX(ts) AS updated_at, COUNT(*) AS n_events FROM events GROUP BY user_id""")
def q_status_timeline(spark, sf_dir):
    src, out, ev = _folder(spark, "event-log"), _folder(spark, "timeline"), table(spark, sf_dir, "events")
    ev.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)  # several triggers, each an upsert
    alarms.status_table(stream, out, _folder(spark, "timeline-progress"), "user_id", "ts", "event_type", "event_id").awaitTermination()
    return spark.read.parquet(out).drop("bucket")


# ================================================================== C2 / C3 / C8 / T1 / V7
@register("forecasting_monthly", sql("SELECT month AS period, SUM(units_sold) AS total_units FROM processed GROUP BY month"))
def q_forecasting_monthly(spark, sf_dir):
    return reports.run_operation(processed(spark, sf_dir), "forecasting")["monthly_sales"]


@register("business_regions", sql("""
SELECT CAST(row_number() OVER (ORDER BY t DESC, region) AS INTEGER) AS rank, region, t AS total_units
FROM (SELECT region, SUM(units_sold) AS t FROM processed WHERE region IS NOT NULL AND category = 'LARGE' GROUP BY region)"""))
def q_business_regions(spark, sf_dir):
    return reports.run_operation(processed(spark, sf_dir), "business_analysis", category="LARGE")["region_ranking"]


@register("bi_tables", sql("""
SELECT 'trend' AS part, strftime(date, '%Y-%m') AS label, SUM(units_sold) AS value FROM processed GROUP BY 2
UNION ALL SELECT 'kpi', 'total_units', CAST(SUM(units_sold) AS DOUBLE) FROM processed
UNION ALL SELECT 'anomaly', CASE WHEN c.units_sold < b.lo THEN 'low' ELSE 'high' END, COUNT(*)
FROM cleaned c, bounds b WHERE c.units_sold < b.lo OR c.units_sold > b.hi GROUP BY 2""").replace("dedup AS (SELECT DISTINCT * FROM sales)",
    "dedup AS (SELECT DISTINCT * REPLACE (CASE WHEN weather_condition = 'A' THEN units_sold * units_sold ELSE units_sold END AS units_sold) FROM sales)"))
def q_bi_tables(spark, sf_dir):
    s = sales_view(spark, sf_dir)
    s = s.withColumn("units_sold", F.when(F.col("weather_condition") == "A", F.col("units_sold") * F.col("units_sold")).otherwise(F.col("units_sold")))
    cleaned = clean.drop_missing(clean.coerce_numeric(clean.parse_dates(clean.dedup_rows(s))), ["date", "units_sold"])
    path = _folder(spark, "bi-cleaned")
    cleaned.write.parquet(path)
    cleaned = spark.read.parquet(path)
    parts = reports.bi_dataset(clean.add_features(clean.outlier_fence(cleaned)), cleaned)
    trend = parts["trend_line"].select(F.lit("trend").alias("part"), F.col("period").alias("label"), F.col("total_units").alias("value"))
    kpi = parts["kpi_card"].select(F.lit("kpi").alias("part"), F.lit("total_units").alias("label"), F.col("total_units").cast("double").alias("value"))
    odd = parts["anomaly_table"].groupBy("side").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return trend.unionByName(kpi).unionByName(odd.select(F.lit("anomaly").alias("part"), F.col("side").alias("label"), "value"))


# ================================================================== P13, large totals, one-month history
@register("report_document_unit_price", REPORT_SQL)
def q_report_document_unit_price(spark, sf_dir):
    return reports.report_document(processed(spark, sf_dir).withColumnRenamed("price", "unit_price"), operation="forecasting")


LARGE = "(COALESCE(c.discount, 0) AS discount, c.units_sold * 10000 AS units_sold)"


@register("markdown_large_totals", markdown_sql().replace("(COALESCE(c.discount, 0) AS discount)", LARGE))
def q_markdown_large_totals(spark, sf_dir):
    p = processed(spark, sf_dir)
    return reports.markdown_lines(p.withColumn("units_sold", F.col("units_sold") * 10000), operation="forecasting")


SHORT_LINES = [(s, {
    0: "'Sales history is too short or uneven to show a trend.'", 1: "'Average monthly growth is not available.'",
    2: "'Highest sales recorded in ' || month_name || '.'", 3: "'Lowest performance observed in ' || month_name || '.'",
    4: "'Peak sales months are ' || month || '.'", 5: "'Forecast confidence is not available.'"}.get(i, e)) for i, (s, e) in enumerate(FORECAST_LINES)]


@register("forecast_narrative_short", sql(", m AS (SELECT DISTINCT CAST(month AS VARCHAR) AS month, monthname(date) AS month_name FROM processed WHERE month = 3)\n")
          + f"SELECT section, ord, text FROM ({lines_sql(SHORT_LINES, 'm')})")
def q_forecast_narrative_short(spark, sf_dir):
    return reports.forecast_narrative(processed(spark, sf_dir).where("month = 3"))
