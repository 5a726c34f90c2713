"""Query registrations: cleaning traps, validation, outlier fence and the
job/event family. Dirty inputs are derived inside each query from the
driver's tables (whole tables, every row)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import parse_log_line
from ..operators import clean, jobs, quality
from ..sources.testdata import sales_view, table
from ..session import scratch_path
from .catalog import _remove as remove
from .catalog import materialised, processed, register, sql
from .prepare import observed_stages

NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


# ================================================================== P1
@register("dedup_rows", """
SELECT DISTINCT * FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error')""")
def q_dedup_rows(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return clean.dedup_rows(ev.unionByName(ev.filter(F.col("event_type") == "error")))


# ================================================================== P2 / P3
@register("header_normalised", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def q_header_normalised(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    messy = p.select(F.col("p_partkey").alias(" P Partkey "), F.col("p_name").alias("P/Name"),
                     F.col("p_brand").alias("p Brand"), F.col("p_type").alias("P_TYPE"),
                     F.col("p_size").alias("﻿P Size"), F.col("p_retailprice").alias("P Retailprice"))
    return clean.normalise_headers(messy)


@register("header_lenient", "SELECT l_orderkey, l_linenumber, l_quantity AS units_sold FROM lineitem")
def q_header_lenient(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    messy = li.select(F.col("l_orderkey").alias(" L_OrderKey"), F.col("l_linenumber").alias("L_LINENUMBER "),
                      F.col("l_quantity").alias("Units Sold"))
    return clean.lenient_headers(messy)


# ================================================================== P4 / P5
DATE_TRAPS = [  # (line number, half of the orders) -> layout of the cell, as a Spark and a DuckDB pattern
    (1, 0, "d/M/yy", "%d/%m/%y"), (1, 1, "d MMM yyyy", "%d %b %Y"), (2, 0, "yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
    (2, 1, "d-MMM-yyyy", "%d-%b-%Y"), (3, 0, "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), (3, 1, "MMMM d, yyyy", "%B %d, %Y"),
    (5, 0, "yyyy-MM-dd", "%Y-%m-%d"), (5, 1, "yyyyMMdd", "%Y%m%d"), (6, 0, "dd/MM/yyyy", "%d/%m/%Y"), (6, 1, "d.M.yyyy", "%d.%m.%Y")]


def _dirty_dates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    at = (F.col("l_shipdate").cast("timestamp_ntz") + F.expr("INTERVAL 13 HOURS 5 MINUTES"))
    text = F.when(F.col("l_linenumber") == 7, F.lit("bad")).when(F.col("l_linenumber") == 4, F.lit("31/02/1996"))
    for line, half, layout, _ in DATE_TRAPS:
        text = text.when((F.col("l_linenumber") == line) & (F.col("l_orderkey") % 2 == half), F.date_format(at, layout))
    dirty = li.select("l_orderkey", "l_linenumber", text.alias("date"), F.col("l_quantity").cast("string").alias("units_sold"))
    path = scratch_path(spark, f"dirty-dates-{uuid.uuid4().hex}")  # written, as an upload is: the cells are text by then
    dirty.write.parquet(path)
    return spark.read.parquet(path)


@register("dates_parsed", """
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_linenumber NOT IN (4, 7)""")
def q_dates_parsed(spark, sf_dir):
    dirty = _dirty_dates(spark, sf_dir).drop("units_sold")
    return clean.drop_missing(clean.parse_dates(dirty, "date"), ["date"])


@register("rejected_rows", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN '31/02/1996' WHEN l_linenumber = 7 THEN 'bad' END AS date,
       CASE WHEN l_linenumber = 4 AND l_orderkey % 3 = 0 THEN 'missing_date' WHEN l_linenumber IN (4, 7) THEN 'invalid_date'
            WHEN l_orderkey % 5 = 0 THEN 'missing_target' ELSE 'invalid_target' END AS reason
FROM lineitem WHERE l_linenumber IN (4, 7) OR l_orderkey % 5 < 2""".replace(
    "CASE WHEN l_linenumber = 4 THEN '31/02/1996' WHEN l_linenumber = 7 THEN 'bad' END AS date",
    "CASE WHEN l_linenumber = 4 AND l_orderkey % 3 = 0 THEN ' ' WHEN l_linenumber = 4 THEN '31/02/1996' WHEN l_linenumber = 7 THEN 'bad' END AS date"))
def q_rejected_rows(spark, sf_dir):
    dirty = _dirty_dates(spark, sf_dir)
    dirty = dirty.withColumns({
        "date": F.when((F.col("l_linenumber") == 4) & (F.col("l_orderkey") % 3 == 0), F.lit(" ")).otherwise(F.col("date")),
        "units_sold": F.when(F.col("l_orderkey") % 5 == 0, F.lit(None)).when(F.col("l_orderkey") % 5 == 1, F.lit("1,000")).otherwise(F.col("units_sold"))})
    out = clean.rejected_rows(dirty)
    late = F.col("reason").isin("missing_date", "invalid_date")
    return out.select("l_orderkey", "l_linenumber", F.when(late, F.col("date")).alias("date"), "reason")


# ================================================================== P6 / P7
@register("numeric_coerced", f"""
SELECT l_orderkey, l_linenumber, units_sold FROM (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN regexp_matches(t, '{NUMBER_RE}') AND isfinite(TRY_CAST(trim(t) AS DOUBLE))
              THEN TRY_CAST(trim(t) AS DOUBLE) END AS units_sold
  FROM (SELECT l_orderkey, l_linenumber,
               CASE WHEN l_linenumber = 3 THEN CAST(l_quantity AS VARCHAR) || 'x'
                    WHEN l_linenumber = 4 THEN ' ' || CAST(l_quantity AS VARCHAR) || ' '
                    WHEN l_linenumber = 5 THEN '1,000'
                    WHEN l_linenumber = 6 THEN 'NaN'
                    WHEN l_linenumber = 7 THEN '1e3'
                    ELSE CAST(l_quantity AS VARCHAR) END AS t FROM lineitem))
WHERE units_sold IS NOT NULL""")
def q_numeric_coerced(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("string")
    text = (F.when(F.col("l_linenumber") == 3, F.concat(q, F.lit("x")))
            .when(F.col("l_linenumber") == 4, F.concat(F.lit(" "), q, F.lit(" ")))
            .when(F.col("l_linenumber") == 5, F.lit("1,000"))
            .when(F.col("l_linenumber") == 6, F.lit("NaN"))
            .when(F.col("l_linenumber") == 7, F.lit("1e3"))
            .otherwise(q))
    dirty = li.select("l_orderkey", "l_linenumber", text.alias("units_sold"))
    return clean.drop_missing(clean.coerce_numeric(dirty, ["units_sold"]), ["units_sold"])


# ================================================================== F1-F3
@register("date_features", """
SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day,
       CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
       COUNT(*) AS n_rows
FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY 1, 2, 3, 4, 5""")
def q_date_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return li.groupBy(*[c.alias(n) for n, c in clean.date_features(F.col("date")).items()]) \
        .agg(F.count(F.lit(1)).alias("n_rows"))


# ================================================================== F4
@register("promotion_flag", """
SELECT o_orderpriority, holiday_promotion,
       CASE WHEN lower(CAST(holiday_promotion AS VARCHAR)) IN ('yes', 'true', '1') THEN 1 ELSE 0 END AS promotion_flag,
       COUNT(*) AS n_orders
FROM (SELECT o_orderpriority,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'YES' WHEN '2-HIGH' THEN 'true' WHEN '3-MEDIUM' THEN '1'
                  WHEN '4-NOT SPECIFIED' THEN '1.0' ELSE NULL END AS holiday_promotion FROM orders)
GROUP BY 1, 2, 3""")
def q_promotion_flag(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pr = F.col("o_orderpriority")
    text = (F.when(pr == "1-URGENT", "YES").when(pr == "2-HIGH", "true").when(pr == "3-MEDIUM", "1")
            .when(pr == "4-NOT SPECIFIED", "1.0").otherwise(F.lit(None)))
    flagged = clean.add_features(o.select(pr, text.alias("holiday_promotion"),
                                          F.col("o_orderdate").cast("date").alias("date")))
    return flagged.groupBy("o_orderpriority", "holiday_promotion", "promotion_flag") \
        .agg(F.count(F.lit(1)).alias("n_orders"))


# ================================================================== V3-V5 / V8-V11
def _dirty_sales(spark, sf_dir):
    """The sales view as raw text without its seasonality column: negative prices and
    units, words behind numbers, discounts over 100."""
    s = sales_view(spark, sf_dir).drop("seasonality")
    text = {c: F.col(c).cast("string") for c in s.columns}
    flag = F.col("weather_condition")
    text["price"] = F.when(flag == "A", F.concat(F.lit("-"), text["price"])).otherwise(text["price"])
    text["units_sold"] = (F.when(flag == "R", F.concat(text["units_sold"], F.lit(" pcs")))
                          .when(F.col("region") == "ASIA", F.concat(F.lit("-"), text["units_sold"])).otherwise(text["units_sold"]))
    text["discount"] = F.when(F.col("region") == "EUROPE", F.lit("150.0")).otherwise(text["discount"])
    return s.select(*[c.alias(n) for n, c in text.items()])


RANGE_ROWS = """
  SELECT 'negative_price' AS rule, 'price' AS "column", COUNT(*) FILTER (WHERE weather_condition = 'A') AS violations FROM sales
  UNION ALL SELECT 'negative_units_sold', 'units_sold', COUNT(*) FILTER (WHERE region = 'ASIA' AND weather_condition <> 'R') FROM sales
  UNION ALL SELECT 'discount_above_100', 'discount', COUNT(*) FILTER (WHERE region = 'EUROPE') FROM sales"""
TYPE_ROWS = """
  SELECT c AS "column", (SELECT COUNT(*) FROM sales) AS cells,
         (SELECT COUNT(*) FROM sales WHERE c <> 'units_sold' OR weather_condition <> 'R') AS numeric_cells
  FROM (VALUES ('inventory_level'), ('units_sold'), ('units_ordered'), ('price'), ('discount'), ('competitor_pricing')) v(c)"""


@register("range_checks", sql(f"""SELECT rule, "column", violations, violations = 0 AS passed FROM ({RANGE_ROWS})"""))
def q_range_checks(spark, sf_dir):
    return quality.range_checks(clean.coerce_numeric(_dirty_sales(spark, sf_dir)))


def _sales_with_null_keys(spark, sf_dir):
    """Distinct rows of the sales view with the PROMO category and the AFRICA region blanked (missing-key trap)."""
    return sales_view(spark, sf_dir, distinct=True, changes={
        "category": F.when(F.col("category") != "PROMO", F.col("category")),
        "region": F.when(F.col("region") != "AFRICA", F.col("region")),
    })


NULL_KEY_VIEW = "SELECT * REPLACE (NULLIF(category, 'PROMO') AS category, NULLIF(region, 'AFRICA') AS region) FROM sales"


@register("null_checks", sql("").replace("dedup AS (SELECT DISTINCT * FROM sales)",
                                         f"dedup AS (SELECT DISTINCT * FROM ({NULL_KEY_VIEW}))") + """
SELECT COUNT(*) FILTER (WHERE category IS NULL) AS null_category,
       COUNT(*) FILTER (WHERE region IS NULL) AS null_region,
       COUNT(*) FILTER (WHERE units_sold IS NULL) AS null_units_sold,
       COUNT(*) FILTER (WHERE price IS NULL) AS null_price,
       COUNT(*) FILTER (WHERE date IS NULL) AS null_date
FROM processed""")
def q_null_checks(spark, sf_dir):
    p = materialised(spark, sf_dir, "null-keys", lambda: _sales_with_null_keys(spark, sf_dir))
    return quality.null_checks(p, ["category", "region", "units_sold", "price", "date"])


@register("null_key_shares", sql("").replace("dedup AS (SELECT DISTINCT * FROM sales)",
                                             f"dedup AS (SELECT DISTINCT * FROM ({NULL_KEY_VIEW}))") + """
, tot AS (SELECT SUM(units_sold) AS t FROM processed)
SELECT category, SUM(units_sold) AS total_units, round(SUM(units_sold) / MAX(t) * 100, 2) AS share_pct
FROM processed, tot WHERE category IS NOT NULL GROUP BY category""")
def q_null_key_shares(spark, sf_dir):
    from ..operators.metrics import shares
    return shares(materialised(spark, sf_dir, "null-keys", lambda: _sales_with_null_keys(spark, sf_dir)), "category")


@register("row_count", sql("SELECT COUNT(*) AS row_count, 21 AS column_count FROM processed"))
def q_row_count(spark, sf_dir):
    return quality.table_shape(processed(spark, sf_dir))


@register("validation_report", sql(f"""
SELECT "check", target, violations, violations = 0 AS passed FROM (
  SELECT 'required_columns' AS "check", c AS target, CAST(c = 'seasonality' AS BIGINT) AS violations
  FROM (VALUES ('date'), ('store_id'), ('product_id'), ('category'), ('region'), ('inventory_level'),
               ('units_sold'), ('units_ordered'), ('demand_forecast'), ('price'), ('discount'),
               ('weather_condition'), ('holiday_promotion'), ('competitor_pricing'), ('seasonality')) v(c)
  UNION ALL SELECT 'numeric_type', "column", cells - numeric_cells FROM ({TYPE_ROWS})
  UNION ALL SELECT rule, "column", violations FROM ({RANGE_ROWS}))"""))
def q_validation_report(spark, sf_dir):
    return quality.validation_report(_dirty_sales(spark, sf_dir))


@register("stage_counts", sql("""
SELECT CAST(ord AS INTEGER) AS ord, stage, CAST(rows AS BIGINT) AS rows FROM (
  SELECT 1 AS ord, 'raw' AS stage, (SELECT COUNT(*) FROM sales) AS rows
  UNION ALL SELECT 2, 'deduplicated', (SELECT COUNT(*) FROM dedup)
  UNION ALL SELECT 3, 'valid_date', (SELECT COUNT(*) FROM dedup WHERE date IS NOT NULL)
  UNION ALL SELECT 4, 'valid_target', (SELECT COUNT(*) FROM cleaned)
  UNION ALL SELECT 5, 'within_fence', (SELECT COUNT(*) FROM processed))"""))
def q_stage_counts(spark, sf_dir):
    path = scratch_path(spark, f"cleaned-{uuid.uuid4().hex}")
    _, counts = observed_stages(sales_view(spark, sf_dir), path)
    remove(spark, path)
    return quality.stage_table(spark, counts)


# ================================================================== A12 / P8 / P9 on events.value
@register("iqr_filter_counts", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper,
       (SELECT COUNT(*) FROM events, b WHERE value >= lower AND value <= upper) AS kept,
       (SELECT COUNT(*) FROM events, b WHERE value < lower OR value > upper) AS rejected
FROM b""")
def q_iqr_filter_counts(spark, sf_dir):
    c = clean.fence_counts(table(spark, sf_dir, "events"), "value")
    return c.select(*[F.round(x, 6).alias(x) for x in ("q1", "q3", "lower", "upper")], "kept", "rejected")


@register("iqr_anomalies", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT event_id, value, CASE WHEN value < lower THEN 'low' ELSE 'high' END AS side
FROM events, b WHERE value < lower OR value > upper""")
def q_iqr_anomalies(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return clean.outlier_anomalies(ev, "value").select("event_id", "value", "side")


# ================================================================== T5-T10 / W6 / W7 on events
@register("recent_100", "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def q_recent_100(spark, sf_dir):
    return jobs.most_recent(table(spark, sf_dir, "events"), "ts", 100, "event_id")


@register("sample_100", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100")
def q_sample_100(spark, sf_dir):
    return jobs.stable_sample(table(spark, sf_dir, "lineitem"), 100, ["l_orderkey", "l_linenumber"])


@register("user_history", "SELECT * FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC")
def q_user_history(spark, sf_dir):
    return jobs.history_for(_stored_events(spark, sf_dir), "user_id", 7, "ts", "event_id").drop("job_status")


@register("user_latest5", """
SELECT e.user_id, CAST(rn AS INTEGER) AS rn, event_id, ts, event_type, value, props, n_total FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e
JOIN (SELECT user_id, COUNT(*) AS n_total FROM events GROUP BY user_id) c ON e.user_id = c.user_id
WHERE rn <= 5""")
def q_user_latest5(spark, sf_dir):
    out = jobs.latest_per_key(table(spark, sf_dir, "events"), "user_id", "ts", 5, "event_id")
    return out.select("user_id", "rn", "event_id", "ts", "event_type", "value", "props", "n_total")


def _stored_events(spark, sf_dir):
    """The events as a job table in its access layout."""
    path = scratch_path(spark, f"stored-jobs-{uuid.uuid4().hex}")
    return jobs.store_jobs(table(spark, sf_dir, "events"), path, "event_type", "user_id", ["event_id"])


@register("job_lookup", "SELECT * FROM events WHERE event_id = 4242")
def q_job_lookup(spark, sf_dir):
    return jobs.lookup(_stored_events(spark, sf_dir), "event_id", 4242).drop("job_status")


@register("jobs_by_status", """
SELECT event_id, user_id, ts, event_type FROM events WHERE upper(event_type) = 'ERROR'""")
def q_jobs_by_status(spark, sf_dir):
    ev = _stored_events(spark, sf_dir)
    return jobs.by_status(ev, "job_status", "error", "ts", "event_id", stored=True).select("event_id", "user_id", "ts", "event_type")


@register("job_latest_status", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest_status, MAX(ts) AS latest_ts, COUNT(*) AS n_events
FROM events GROUP BY user_id""")
def q_job_latest_status(spark, sf_dir):
    return jobs.latest_status(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@register("stage_durations", """
SELECT user_id, event_id, event_type,
       (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS duration_sec
FROM events""")
def q_stage_durations(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return jobs.step_durations(ev, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "duration_sec")


# ================================================================== X1-X3 (batch form)
@register("failure_alarm_5min", """
SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS window_end,
       COUNT(*) FILTER (WHERE event_type = 'error') AS failures
FROM events GROUP BY 1, 2 HAVING COUNT(*) FILTER (WHERE event_type = 'error') > 0""")
def q_failure_alarm_5min(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return jobs.window_alarm(ev, "ts", F.col("event_type") == "error")


@register("error_by_source_5min", """
SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS window_end,
       user_id, COUNT(*) FILTER (WHERE event_type = 'error') AS failures
FROM events GROUP BY 1, 2, 3 HAVING COUNT(*) FILTER (WHERE event_type = 'error') > 0""")
def q_error_by_source_5min(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return jobs.window_alarm(ev, "ts", F.col("event_type") == "error", keys=["user_id"])


@register("value_p95_5min", """
SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS window_end,
       COUNT(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY 1, 2""")
def q_value_p95_5min(spark, sf_dir):
    out = jobs.window_percentile(table(spark, sf_dir, "events"), "ts", "value", 0.95)
    return out.withColumn("p95", F.round("p95", 6))


# ================================================================== F12 / F13
def _log_lines(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING") \
        .otherwise("INFO")
    run = F.when(F.col("event_type") != "view",
                 F.concat(F.lit("RUN_ID="), F.lower(F.lpad(F.hex(F.col("user_id")), 8, "0")), F.lit(" | "))) \
        .otherwise(F.lit(""))
    line = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" | "), level,
                    F.lit(" | "), run, F.lit("Stage "), F.col("event_type"), F.lit(" value="),
                    F.col("value").cast("string"))
    return ev.select("event_id", line.alias("value"))


@register("run_log_parse", """
SELECT event_id, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
       CASE WHEN event_type <> 'view' THEN lower(lpad(hex(user_id), 8, '0')) END AS run_id,
       'Stage ' || event_type || ' value=' || CAST(value AS VARCHAR) AS message
FROM events""")
def q_run_log_parse(spark, sf_dir):
    lines = _log_lines(spark, sf_dir)
    f = parse_log_line(F.col("value"))
    return lines.select("event_id", f["ts"].cast("timestamp_ntz").alias("ts"), f["level"].alias("level"),
                        f["run_id"].alias("run_id"), f["message"].alias("message"))


@register("status_badges", """
SELECT upper(COALESCE(NULLIF(s, ''), 'UNKNOWN')) AS status_norm,
       CASE upper(COALESCE(NULLIF(s, ''), 'UNKNOWN')) WHEN 'SUCCEEDED' THEN 'success' WHEN 'FAILED' THEN 'failed'
            ELSE 'running' END AS badge, COUNT(*) AS n
FROM (SELECT CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'Failed' WHEN 'view' THEN NULL
                  WHEN 'signup' THEN '' ELSE event_type END AS s FROM events)
GROUP BY 1, 2""")
def q_status_badges(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    s = (F.when(et == "purchase", "succeeded").when(et == "error", "Failed").when(et == "view", F.lit(None))
         .when(et == "signup", "").otherwise(et))
    b = jobs.with_status_badge(ev.select(s.alias("status")), "status")
    return b.groupBy("status_norm", "badge").agg(F.count(F.lit(1)).alias("n"))


# ================================================================== V2
@register("type_report", sql(f"""SELECT "column", cells, numeric_cells, cells = numeric_cells AS is_numeric FROM ({TYPE_ROWS})"""))
def q_type_report(spark, sf_dir):
    return quality.type_report(_dirty_sales(spark, sf_dir))


# ================================================================== P10
DISCOUNT_GAP_VIEW = "SELECT * REPLACE (CASE WHEN weather_condition = 'R' THEN NULL ELSE discount END AS discount) FROM sales"


@register("discount_filled", sql("").replace("dedup AS (SELECT DISTINCT * FROM sales)",
                                             f"dedup AS (SELECT DISTINCT * FROM ({DISCOUNT_GAP_VIEW}))") + """
SELECT weather_condition, COUNT(*) FILTER (WHERE discount = 0) AS zero_discounts,
       CAST(SUM(CAST(discount AS DECIMAL(38,6))) AS DOUBLE) AS discount_total, COUNT(*) AS n_rows
FROM processed GROUP BY weather_condition""")
def q_discount_filled(spark, sf_dir):
    gaps = F.when(F.col("weather_condition") != "R", F.col("discount"))
    p = materialised(spark, sf_dir, "discount-gaps", lambda: sales_view(spark, sf_dir, distinct=True, changes={"discount": gaps}))
    return p.groupBy("weather_condition").agg(
        F.count_if(F.col("discount") == 0).alias("zero_discounts"),
        F.sum(F.col("discount").cast("decimal(38,6)")).cast("double").alias("discount_total"),
        F.count(F.lit(1)).alias("n_rows"))
