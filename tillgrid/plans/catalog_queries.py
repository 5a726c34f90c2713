"""Query registrations over the processed sales table (sales family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import month_name
from ..operators import metrics, ranking
from ..operators import forecast as fc
from . import reports
from .catalog import processed, register, sql

# ------------------------------------------------------------------ helpers
MONTHS_SQL = "CAST(month AS INTEGER)"
CAT_SUMS = "cs AS (SELECT category, SUM(units_sold) AS total_units FROM processed WHERE category IS NOT NULL GROUP BY category)"
REG_SUMS = "rs AS (SELECT region, SUM(units_sold) AS total_units FROM processed WHERE region IS NOT NULL GROUP BY region)"
MON_SUMS = "ms AS (SELECT month, SUM(units_sold) AS total_units FROM processed WHERE month IS NOT NULL GROUP BY month)"


# ------------------------------------------------------------------ A5 / A6 / A7 / A8
@register("units_by_month", sql("SELECT month, SUM(units_sold) AS total_units FROM processed GROUP BY month"))
def q_units_by_month(spark, sf_dir):
    return metrics.units_by_month(processed(spark, sf_dir))


@register("units_by_year_month", sql(
    "SELECT strftime(date, '%Y-%m') AS period, SUM(units_sold) AS total_units FROM processed GROUP BY 1"))
def q_units_by_year_month(spark, sf_dir):
    return metrics.units_by_year_month(processed(spark, sf_dir))


@register("category_sales", sql(
    "SELECT category, SUM(units_sold) AS total_units FROM processed WHERE category IS NOT NULL GROUP BY category"))
def q_category_sales(spark, sf_dir):
    return metrics.category_sales(processed(spark, sf_dir))


@register("region_sales", sql(
    "SELECT region, SUM(units_sold) AS total_units FROM processed WHERE region IS NOT NULL GROUP BY region"))
def q_region_sales(spark, sf_dir):
    return metrics.region_sales(processed(spark, sf_dir))


# ------------------------------------------------------------------ A11 / F6
@register("best_worst_month", sql(f""", {MON_SUMS},
bw AS (SELECT (SELECT month FROM ms ORDER BY total_units DESC, month LIMIT 1) AS best_month,
              (SELECT month FROM ms ORDER BY total_units ASC, month LIMIT 1) AS worst_month)
SELECT best_month, monthname(make_date(2000, best_month, 1)) AS best_month_name,
       worst_month, monthname(make_date(2000, worst_month, 1)) AS worst_month_name FROM bw"""))
def q_best_worst_month(spark, sf_dir):
    bw = ranking.best_worst(metrics.units_by_month(processed(spark, sf_dir)), "month")
    return bw.select("best_month", month_name(F.col("best_month")).alias("best_month_name"),
                     "worst_month", month_name(F.col("worst_month")).alias("worst_month_name"))


# ------------------------------------------------------------------ T2 / T3 / T4
@register("top3_months", sql(f""", {MON_SUMS}
SELECT CAST(row_number() OVER (ORDER BY total_units DESC, month) AS INTEGER) AS rank, month, total_units
FROM ms ORDER BY total_units DESC, month LIMIT 3"""))
def q_top3_months(spark, sf_dir):
    return ranking.top_k(metrics.units_by_month(processed(spark, sf_dir)), "month", 3)


@register("top3_categories", sql(f""", {CAT_SUMS}
SELECT CAST(row_number() OVER (ORDER BY total_units DESC, category) AS INTEGER) AS rank, category, total_units
FROM cs ORDER BY total_units DESC, category LIMIT 3"""))
def q_top3_categories(spark, sf_dir):
    return ranking.top_k(metrics.category_sales(processed(spark, sf_dir)), "category", 3)


@register("bottom3_categories", sql(f""", {CAT_SUMS},
tail AS (SELECT * FROM cs ORDER BY total_units ASC, category DESC LIMIT 3)
SELECT CAST(row_number() OVER (ORDER BY total_units DESC, category) AS INTEGER) AS rank, category, total_units FROM tail"""))
def q_bottom3_categories(spark, sf_dir):
    return ranking.bottom_k(metrics.category_sales(processed(spark, sf_dir)), "category", 3)


# ------------------------------------------------------------------ A14
def _share_sql(key: str) -> str:
    return sql(f""", tot AS (SELECT SUM(units_sold) AS t FROM processed),
g AS (SELECT {key}, SUM(units_sold) AS total_units FROM processed WHERE {key} IS NOT NULL GROUP BY {key})
SELECT {key}, total_units, CASE WHEN t = 0 THEN 0.0 ELSE round(total_units / t * 100, 2) END AS share_pct
FROM g, tot""")


@register("category_share", _share_sql("category"))
def q_category_share(spark, sf_dir):
    return metrics.shares(processed(spark, sf_dir), "category")


@register("region_share", _share_sql("region"))
def q_region_share(spark, sf_dir):
    return metrics.shares(processed(spark, sf_dir), "region")


# ------------------------------------------------------------------ A13 / R5 / R6
@register("performance_gap_health", sql(f""", {CAT_SUMS},
gap AS (SELECT COALESCE(MAX(total_units) - MIN(total_units), 0.0) AS performance_gap FROM cs)
SELECT performance_gap,
       CASE WHEN performance_gap > 50000 THEN 'Unbalanced ⚠️' ELSE 'Stable ✅' END AS business_health,
       CASE WHEN performance_gap < 10000 THEN 'Business Health: Stable' ELSE 'High Variance' END AS report_health
FROM gap"""))
def q_performance_gap_health(spark, sf_dir):
    return reports.gap_health(metrics.category_sales(processed(spark, sf_dir)))


# ------------------------------------------------------------------ W4
@register("region_ranking", sql(f""", {REG_SUMS}
SELECT CAST(row_number() OVER (ORDER BY total_units DESC, region) AS INTEGER) AS rank, region, total_units FROM rs"""))
def q_region_ranking(spark, sf_dir):
    return ranking.ranking(metrics.region_sales(processed(spark, sf_dir)), "region")


# ------------------------------------------------------------------ A15 / A16 / P11-P17
KPI_SQL = """CAST(COALESCE(SUM(units_sold), 0) AS BIGINT) AS total_units,
       round(AVG(units_sold), 2) AS avg_units,
       CAST(round(COALESCE(SUM(CAST(revenue AS DECIMAL(38,6))), 0), 2) AS DOUBLE) AS total_revenue,
       CAST(round(AVG(CAST(revenue AS DECIMAL(38,6))), 2) AS DOUBLE) AS avg_revenue"""


@register("dual_kpis", sql(f"""SELECT {KPI_SQL} FROM (SELECT *, units_sold * price AS revenue FROM processed)"""))
def q_dual_kpis(spark, sf_dir):
    return metrics.dual_kpis(metrics.with_revenue(processed(spark, sf_dir)))


FILTER = dict(category="LARGE", region="ASIA", year="1998")


@register("filtered_kpis", sql(f"""SELECT {KPI_SQL} FROM (SELECT *, units_sold * price AS revenue FROM processed
WHERE category = 'LARGE' AND region = 'ASIA' AND year = 1998)"""))
def q_filtered_kpis(spark, sf_dir):
    return metrics.filtered_kpis(processed(spark, sf_dir), **FILTER)


@register("filtered_kpis_all", sql(f"""SELECT {KPI_SQL} FROM (SELECT *, units_sold * price AS revenue FROM processed)"""))
def q_filtered_kpis_all(spark, sf_dir):
    return metrics.filtered_kpis(processed(spark, sf_dir))


@register("filtered_kpis_empty", sql(f"""SELECT {KPI_SQL} FROM (SELECT *, units_sold * price AS revenue FROM processed
WHERE category = 'LARGE' AND region = 'ASIA' AND year = 1990)"""))
def q_filtered_kpis_empty(spark, sf_dir):
    return metrics.filtered_kpis(processed(spark, sf_dir), category="LARGE", region="ASIA", year=1990)


# ------------------------------------------------------------------ A9 / A10
@register("distinct_counts", sql(
    "SELECT COUNT(DISTINCT category) AS category_count, COUNT(DISTINCT region) AS region_count FROM processed"))
def q_distinct_counts(spark, sf_dir):
    return metrics.distinct_counts(processed(spark, sf_dir))


@register("dropdown_values", sql("""
SELECT 'category' AS kind, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS ord, value
  FROM (SELECT DISTINCT category AS value FROM processed WHERE category IS NOT NULL)
UNION ALL
SELECT 'region', CAST(row_number() OVER (ORDER BY value) AS INTEGER), value
  FROM (SELECT DISTINCT region AS value FROM processed WHERE region IS NOT NULL)
UNION ALL
SELECT 'year', CAST(row_number() OVER (ORDER BY y) AS INTEGER), CAST(y AS VARCHAR)
  FROM (SELECT DISTINCT year AS y FROM processed WHERE year IS NOT NULL)"""))
def q_dropdown_values(spark, sf_dir):
    return metrics.dropdown_values(processed(spark, sf_dir))


# ------------------------------------------------------------------ A17
@register("sales_cube", sql("""
SELECT CASE grouping(category, region, month, year) WHEN 15 THEN 'all' WHEN 7 THEN 'category'
            WHEN 11 THEN 'region' WHEN 13 THEN 'month' ELSE 'year' END AS grain,
       category, region, month, year,
       COALESCE(SUM(units_sold), 0.0) AS total_units, COUNT(units_sold) AS n_units,
       CAST(round(COALESCE(SUM(CAST(units_sold * price AS DECIMAL(38,6))), 0), 2) AS DOUBLE) AS total_revenue,
       COUNT(units_sold * price) AS n_revenue, COUNT(*) AS n_rows
FROM processed
GROUP BY GROUPING SETS ((), (category), (region), (month), (year))
HAVING grouping(category, region, month, year) = 15
    OR (grouping(category, region, month, year) = 7 AND category IS NOT NULL)
    OR (grouping(category, region, month, year) = 11 AND region IS NOT NULL)
    OR (grouping(category, region, month, year) = 13 AND month IS NOT NULL)
    OR (grouping(category, region, month, year) = 14 AND year IS NOT NULL)"""))
def q_sales_cube(spark, sf_dir):
    cube = metrics.sales_cube(processed(spark, sf_dir))
    return cube.withColumn("total_revenue", F.round("total_revenue", 2).cast("double"))


# ------------------------------------------------------------------ W1-W5
@register("month_growth", sql(f""", {MON_SUMS},
g AS (SELECT month AS period, total_units, lag(total_units) OVER (ORDER BY month) AS previous_units FROM ms)
SELECT period, total_units, previous_units,
       CASE WHEN previous_units = 0 THEN NULL ELSE total_units / previous_units - 1 END AS growth
FROM g WHERE previous_units IS NOT NULL"""))
def q_month_growth(spark, sf_dir):
    return fc.month_growth(fc.monthly_totals(processed(spark, sf_dir)))


FORECAST_CTE = f""", {MON_SUMS},
g AS (SELECT month, total_units, lag(total_units) OVER (ORDER BY month) AS prev FROM ms),
s AS (SELECT AVG(total_units / prev - 1) AS avg_growth FROM g WHERE prev IS NOT NULL),
lst AS (SELECT arg_max(total_units, month) AS last_units, COUNT(*) AS n_periods FROM ms),
rec AS (
  SELECT 1 AS step, last_units * (1 + avg_growth) AS v, avg_growth FROM lst, s
  UNION ALL
  SELECT step + 1, v * (1 + avg_growth), avg_growth FROM rec WHERE step < 6)"""


@register("growth_forecast", sql(FORECAST_CTE + """
SELECT CAST(step AS INTEGER) AS step, 'Month+' || CAST(step AS VARCHAR) AS label, round(v, 2) AS forecast FROM rec""",
    recursive=True))
def q_growth_forecast(spark, sf_dir):
    return fc.forecast_steps(fc.growth_summary(fc.monthly_totals(processed(spark, sf_dir))))


@register("growth_summary", sql(f""", {MON_SUMS},
g AS (SELECT month, total_units, lag(total_units) OVER (ORDER BY month) AS prev FROM ms)
SELECT (SELECT COUNT(*) FROM ms) AS n_periods,
       round((SELECT AVG(total_units / prev - 1) FROM g WHERE prev IS NOT NULL), 10) AS avg_growth,
       (SELECT arg_max(total_units, month) FROM ms) AS last_units, 'ok' AS status"""))
def q_growth_summary(spark, sf_dir):
    s = fc.growth_summary(fc.monthly_totals(processed(spark, sf_dir)))
    return s.withColumn("avg_growth", F.round("avg_growth", 10))
