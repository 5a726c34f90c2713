"""Query registrations for the composite reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import currency_text, rewrite_month_numbers
from . import reports
from .catalog import processed, register, sql

MONTH_CASE = "CASE {x} " + " ".join(
    f"WHEN '{i}' THEN '{n}'" for i, n in enumerate(
        ["January", "February", "March", "April", "May", "June", "July", "August",
         "September", "October", "November", "December"], start=1)) + " END"

FORECAST_BASE = """, ms AS (SELECT month, SUM(units_sold) AS total_units FROM processed WHERE month IS NOT NULL GROUP BY month),
gr AS (SELECT month, total_units, lag(total_units) OVER (ORDER BY month) AS prev FROM ms),
s AS (SELECT AVG(total_units / prev - 1) AS avg_growth FROM gr WHERE prev IS NOT NULL),
lst AS (SELECT arg_max(total_units, month) AS last_units FROM ms),
tot AS (SELECT CAST(COALESCE(SUM(units_sold), 0) AS BIGINT) AS total_sales, round(AVG(units_sold), 2) AS avg_sales FROM processed),
top AS (SELECT string_agg(CAST(month AS VARCHAR), ', ' ORDER BY total_units DESC, month) AS top_months
        FROM (SELECT * FROM ms ORDER BY total_units DESC, month LIMIT 3)),
fm AS (
  SELECT total_sales, avg_sales,
         round(last_units * (1 + avg_growth), 2) AS nxt, avg_growth, top_months,
         (SELECT month FROM ms ORDER BY total_units DESC, month LIMIT 1) AS best,
         (SELECT month FROM ms ORDER BY total_units ASC, month LIMIT 1) AS worst
  FROM tot, s, lst, top),
m AS (
  SELECT total_sales, avg_sales, nxt AS next_month_forecast,
         CAST(CAST(round_even(nxt * 0.95, 0) AS BIGINT) AS VARCHAR) || ' - ' ||
           CAST(CAST(round_even(nxt * 1.05, 0) AS BIGINT) AS VARCHAR) AS forecast_range,
         CAST(round(avg_growth * 100, 2) AS VARCHAR) || '% (' ||
           CASE WHEN avg_growth > 0 THEN 'Increasing 📈' ELSE 'Decreasing 📉' END || ')' AS growth_display,
         CASE WHEN avg_growth > 0 THEN 'increasing' ELSE 'decreasing' END AS trend,
         CASE WHEN avg_growth > 0.05 THEN 'Strong Growth' WHEN avg_growth > 0 THEN 'Moderate Growth'
              WHEN avg_growth > -0.05 THEN 'Moderate Decline' ELSE 'Strong Decline' END AS trend_strength,
         CASE WHEN abs(avg_growth) < 0.02 THEN 'Low' WHEN abs(avg_growth) < 0.05 THEN 'Medium' ELSE 'High' END AS forecast_confidence,
         CASE WHEN avg_growth < 0 THEN 'Declining Demand ⚠️' ELSE 'Stable Demand ✅' END AS risk_indicator,
         monthname(make_date(2000, best, 1)) AS best_month,
         monthname(make_date(2000, worst, 1)) AS worst_month,
         avg_growth, top_months, 'ok' AS status
  FROM fm)"""


def lines_sql(items: list[tuple[str, str]], source: str = "m") -> str:
    """(section, text-expression) pairs -> rows (section, ord, text), NULL texts dropped."""
    parts = [f"SELECT {i} AS pos, '{sec}' AS section, {expr} AS text FROM {source}"
             for i, (sec, expr) in enumerate(items)]
    return ("SELECT section, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS ord, text FROM ("
            + "\nUNION ALL\n".join(parts) + ") WHERE text IS NOT NULL")


FORECAST_LINES = [
    ("insight", "'Sales are showing a ' || trend || ' trend over time.'"),
    ("insight", "'Average monthly growth is ' || CAST(round(avg_growth * 100, 2) AS VARCHAR) || '%.'"),
    ("insight", "'Highest sales recorded in ' || best_month || '.'"),
    ("insight", "'Lowest performance observed in ' || worst_month || '.'"),
    ("insight", "'Peak sales months are ' || top_months || '.'"),
    ("insight", "'Forecast confidence is ' || forecast_confidence || ', indicating prediction reliability.'"),
    ("insight", "'Forecast is based on past sales trends and assumes similar future conditions.'"),
    ("recommendation", "'Adjust inventory based on upcoming demand forecast.'"),
    ("recommendation", "'Focus marketing efforts during high-performing months.'"),
    ("recommendation", "'Investigate causes behind low-performing periods.'"),
    ("recommendation", "'Prepare for demand fluctuations using forecast trends.'"),
]


@register("forecast_metrics", sql(FORECAST_BASE + """
SELECT total_sales, avg_sales, next_month_forecast, forecast_range, growth_display, trend, trend_strength,
       forecast_confidence, risk_indicator, best_month, worst_month, round(avg_growth, 10) AS avg_growth,
       top_months, status FROM m"""))
def q_forecast_metrics(spark, sf_dir):
    m = reports.forecast_metrics(processed(spark, sf_dir))
    return m.withColumn("avg_growth", F.round("avg_growth", 10))


@register("forecast_narrative", sql(FORECAST_BASE + "\n" + lines_sql(FORECAST_LINES)))
def q_forecast_narrative(spark, sf_dir):
    return reports.forecast_narrative(processed(spark, sf_dir))


BUSINESS_BASE = """, base AS (SELECT *, units_sold * price AS revenue FROM processed),
tot AS (SELECT CAST(COALESCE(SUM(units_sold), 0) AS BIGINT) AS total_sales, round(AVG(units_sold), 2) AS avg_sales,
               SUM(units_sold) AS t FROM base),
cs AS (SELECT category, SUM(units_sold) AS total_units FROM base WHERE category IS NOT NULL GROUP BY category),
rs AS (SELECT region, SUM(units_sold) AS total_units FROM base WHERE region IS NOT NULL GROUP BY region),
csh AS (SELECT cs.*, CASE WHEN t = 0 THEN 0.0 ELSE round(total_units / t * 100, 2) END AS share_pct FROM cs, tot),
rsh AS (SELECT rs.*, CASE WHEN t = 0 THEN 0.0 ELSE round(total_units / t * 100, 2) END AS share_pct FROM rs, tot),
m AS (
  SELECT total_sales, avg_sales,
    COALESCE((SELECT category FROM csh ORDER BY total_units DESC, category LIMIT 1), 'N/A') AS top_category,
    COALESCE((SELECT region FROM rsh ORDER BY total_units DESC, region LIMIT 1), 'N/A') AS top_region,
    (SELECT COUNT(*) FROM cs) AS category_count,
    (SELECT COUNT(*) FROM rs) AS region_count,
    CAST((SELECT COALESCE(MAX(total_units) - MIN(total_units), 0.0) FROM cs) AS DOUBLE) AS performance_gap,
    CASE WHEN (SELECT COALESCE(MAX(total_units) - MIN(total_units), 0.0) FROM cs) > 50000
         THEN 'Unbalanced ⚠️' ELSE 'Stable ✅' END AS business_health,
    COALESCE((SELECT category FROM csh ORDER BY total_units ASC, category LIMIT 1), 'N/A') AS lowest_category,
    COALESCE((SELECT region FROM rsh ORDER BY total_units ASC, region LIMIT 1), 'N/A') AS lowest_region,
    (SELECT share_pct FROM csh ORDER BY total_units DESC, category LIMIT 1) AS top_category_share,
    (SELECT share_pct FROM csh ORDER BY total_units ASC, category LIMIT 1) AS lowest_category_share,
    (SELECT share_pct FROM rsh ORDER BY total_units DESC, region LIMIT 1) AS top_region_share,
    (SELECT share_pct FROM rsh ORDER BY total_units ASC, region LIMIT 1) AS lowest_region_share
  FROM tot)"""


def _share(c: str) -> str:
    return f"COALESCE(CAST({c} AS VARCHAR), '0')"


BUSINESS_LINES = [
    ("insight", f"top_category || ' contributes ' || {_share('top_category_share')} || '% of total sales.'"),
    ("insight", f"lowest_category || ' is underperforming with only ' || {_share('lowest_category_share')} || '% share.'"),
    ("insight", f"top_region || ' region dominates with ' || {_share('top_region_share')} || '% of total sales.'"),
    ("insight", f"lowest_region || ' region has the lowest contribution at ' || {_share('lowest_region_share')} || '%.'"),
    ("insight", "'There is a performance gap of ' || CAST(CAST(performance_gap AS BIGINT) AS VARCHAR) || ' units between top and lowest category.'"),
    ("insight", "'Sales distribution varies significantly across categories and regions.'"),
    ("insight", "CASE WHEN COALESCE(top_category_share, 0) > 40 THEN top_category || ' dominates heavily → business dependency risk.' END"),
    ("insight", "CASE WHEN COALESCE(lowest_category_share, 0) < 10 THEN lowest_category || ' has very low contribution → consider restructuring.' END"),
    ("recommendation", "'Increase investment in ' || top_category || ' to maximize returns.'"),
    ("recommendation", "'Improve strategy for ' || lowest_category || ' category to boost performance.'"),
    ("recommendation", "'Expand operations in ' || top_region || ' region.'"),
    ("recommendation", "'Investigate low demand in ' || lowest_region || ' region.'"),
    ("recommendation", "'Optimize inventory allocation based on category and region demand.'"),
    ("recommendation", "'Focus marketing efforts on high-performing segments.'"),
]


@register("business_metrics", sql(BUSINESS_BASE + "\nSELECT * FROM m"))
def q_business_metrics(spark, sf_dir):
    return reports.business_metrics(processed(spark, sf_dir))


@register("business_narrative", sql(BUSINESS_BASE + "\n" + lines_sql(BUSINESS_LINES)))
def q_business_narrative(spark, sf_dir):
    return reports.business_narrative(processed(spark, sf_dir))


@register("business_metrics_filtered", sql(
    BUSINESS_BASE.replace("FROM processed),", "FROM processed WHERE region = 'EUROPE' AND year = 1996),", 1)
    + "\nSELECT * FROM m"))
def q_business_metrics_filtered(spark, sf_dir):
    return reports.business_metrics(processed(spark, sf_dir), region="EUROPE", year="1996")


# ------------------------------------------------------------------ C4
@register("dashboard_kpis", sql(""", cs AS (SELECT category, SUM(units_sold) AS u FROM processed WHERE category IS NOT NULL GROUP BY 1),
rs AS (SELECT region, SUM(units_sold) AS u FROM processed WHERE region IS NOT NULL GROUP BY 1)
SELECT CAST(COALESCE(SUM(units_sold), 0) AS BIGINT) AS total_sales, round(AVG(units_sold), 2) AS avg_sales,
       (SELECT category FROM cs ORDER BY u DESC, category LIMIT 1) AS top_category,
       (SELECT region FROM rs ORDER BY u DESC, region LIMIT 1) AS top_region
FROM processed"""))
def q_dashboard_kpis(spark, sf_dir):
    return reports.dashboard_kpis(processed(spark, sf_dir))


@register("dashboard_series", sql("""
SELECT 'monthly' AS chart, strftime(date, '%Y-%m') AS label, SUM(units_sold) AS value FROM processed GROUP BY 2
UNION ALL
SELECT 'category', category, SUM(units_sold) FROM processed WHERE category IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'region', region, SUM(units_sold) FROM processed WHERE region IS NOT NULL GROUP BY 2"""))
def q_dashboard_series(spark, sf_dir):
    return reports.dashboard_series(processed(spark, sf_dir))


# ------------------------------------------------------------------ C5
@register("results_view", sql("""
SELECT CAST(COALESCE(SUM(units_sold), 0) AS BIGINT) AS total_units,
       round(AVG(units_sold), 2) AS avg_units,
       CAST(round(COALESCE(SUM(CAST(units_sold * price AS DECIMAL(38,6))), 0), 2) AS DOUBLE) AS total_revenue,
       CAST(round(AVG(CAST(units_sold * price AS DECIMAL(38,6))), 2) AS DOUBLE) AS avg_revenue,
       (SELECT CAST(to_json(list(v ORDER BY v)) AS VARCHAR) FROM (SELECT DISTINCT category AS v FROM processed WHERE category IS NOT NULL)) AS category_list,
       (SELECT CAST(to_json(list(v ORDER BY v)) AS VARCHAR) FROM (SELECT DISTINCT region AS v FROM processed WHERE region IS NOT NULL)) AS region_list,
       (SELECT CAST(to_json(list(CAST(v AS INTEGER) ORDER BY v)) AS VARCHAR) FROM (SELECT DISTINCT year AS v FROM processed WHERE year IS NOT NULL)) AS year_list
FROM processed WHERE category = 'SMALL' AND year = 1999"""))
def q_results_view(spark, sf_dir):
    return reports.results_view(processed(spark, sf_dir), category="SMALL", year="1999")


# ------------------------------------------------------------------ C6 (+F7, F11)
def _rewrite_sql(t: str) -> str:
    names = (f"list_filter(list_transform(string_split(trim(string_split({t}, 'are')[-1]), ','), "
             f"lambda p: {MONTH_CASE.format(x='trim(p)')}), lambda x: x IS NOT NULL)")
    return (f"CASE WHEN contains({t}, 'Peak sales months are') AND len({names}) > 0 "
            f"THEN 'Peak sales months are ' || array_to_string({names}, ', ') || '.' ELSE {t} END")


def _currency_sql(v: str) -> str:
    return f"'₹' || format('{{:,.2f}}', COALESCE(round(CAST({v} AS DOUBLE), 2), 0.0))"


REPORT_HEAD = [
    ("title", "'Analytics Report: sales.csv'"),
    ("executive_summary", "'Processed ' || CAST(row_count AS VARCHAR) || ' rows using forecasting mode.'"),
    ("dataset_overview", "'Rows used in analysis: ' || CAST(row_count AS VARCHAR)"),
    ("dataset_overview", "'Columns found in dataset: 21'"),
    ("dataset_overview", "'Categories: ' || CAST(category_count AS VARCHAR)"),
    ("dataset_overview", "'Regions: ' || CAST(region_count AS VARCHAR)"),
    ("preprocessing", "'Duplicate rows removed'"),
    ("preprocessing", "'Missing values handled using imputation'"),
    ("preprocessing", "'Outliers detected and treated'"),
    ("preprocessing", "'Date columns standardized'"),
    ("preprocessing", "'New features created (month, region, category)'"),
    ("preprocessing", "'Data validated for consistency'"),
    ("key_metrics", "'Total Sales: ' || CAST(total_sales AS VARCHAR)"),
    ("key_metrics", "'Average Sales: ' || CAST(avg_sales AS VARCHAR)"),
    ("key_metrics", "'Top Category: ' || top_category"),
    ("key_metrics", "'Top Region: ' || top_region"),
    ("key_metrics", "'Category Count: ' || CAST(category_count AS VARCHAR)"),
    ("key_metrics", "'Region Count: ' || CAST(region_count AS VARCHAR)"),
    ("key_metrics", "'Performance Gap: ' || CAST(CAST(performance_gap AS BIGINT) AS VARCHAR)"),
    ("key_metrics", "CASE WHEN performance_gap < 10000 THEN 'Business Health: Stable' ELSE 'High Variance' END"),
    ("sales_distribution", "'Top Category: ' || top_category"),
    ("sales_distribution", "'Top Region: ' || top_region"),
    ("sales_distribution", "'Lowest Category: ' || lowest_category"),
    ("kpis", "'Total Sales: ' || CAST(total_sales AS VARCHAR)"),
    ("kpis", "'Average Sales: ' || CAST(avg_sales AS VARCHAR)"),
    ("kpis", f"'Total Revenue: ' || {_currency_sql('total_revenue')}"),
    ("kpis", f"'Avg Revenue: ' || {_currency_sql('avg_revenue')}"),
]


def _report_sql() -> str:
    fb = FORECAST_BASE.replace(", ms AS", ", ms AS", 1).replace("tot AS (", "ftot AS (", 1) \
        .replace("FROM tot, s, lst, top", "FROM ftot, s, lst, top").replace("\nm AS (", "\nfmx AS (", 1)
    bb = BUSINESS_BASE.replace("\nm AS (", "\nbm AS (", 1)
    rev = """, rv AS (SELECT CAST(round(COALESCE(SUM(CAST(units_sold * price AS DECIMAL(38,6))), 0), 2) AS DOUBLE) AS total_revenue,
       CAST(round(AVG(CAST(units_sold * price AS DECIMAL(38,6))), 2) AS DOUBLE) AS avg_revenue,
       COUNT(*) AS row_count FROM processed),
one AS (SELECT * FROM bm, rv)"""
    head = lines_sql(REPORT_HEAD, "one")
    narr = lines_sql([(sec + "s", e) for sec, e in FORECAST_LINES], "fmx")
    return sql(fb + bb + rev + f"""
SELECT section, ord, text FROM ({head})
UNION ALL
SELECT section, ord, {_rewrite_sql('text')} AS text FROM ({narr})""")


REPORT_SQL = _report_sql()


@register("report_document", REPORT_SQL)
def q_report_document(spark, sf_dir):
    return reports.report_document(processed(spark, sf_dir), operation="forecasting")


# ------------------------------------------------------------------ F7 / F11 on their own
@register("month_text_rewrite", sql(FORECAST_BASE + f"""
SELECT t AS original, {_rewrite_sql('t')} AS rewritten FROM (
  SELECT 'Peak sales months are ' || top_months || '.' AS t FROM m
  UNION ALL SELECT 'Peak sales months are ' || top_months FROM m
  UNION ALL SELECT 'Highest sales recorded in ' || best_month || '.' FROM m)"""))
def q_month_text_rewrite(spark, sf_dir):
    m = reports.forecast_metrics(processed(spark, sf_dir))
    t = m.select(F.explode(F.array(
        F.concat(F.lit("Peak sales months are "), F.col("top_months"), F.lit(".")),
        F.concat(F.lit("Peak sales months are "), F.col("top_months")),
        F.concat(F.lit("Highest sales recorded in "), F.col("best_month"), F.lit(".")))).alias("original"))
    return t.select("original", rewrite_month_numbers(F.col("original")).alias("rewritten"))


@register("currency_text", sql(f"""
SELECT category, {_currency_sql('rev')} AS revenue_text FROM (
  SELECT category, round(SUM(CAST(units_sold * price AS DECIMAL(38,6))), 2) AS rev
  FROM processed WHERE category IS NOT NULL GROUP BY category)"""))
def q_currency_text(spark, sf_dir):
    from ..operators.metrics import exact
    p = processed(spark, sf_dir)
    g = p.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.round(F.sum(exact(F.col("units_sold") * F.col("price"))), 2).alias("rev"))
    return g.select("category", currency_text(F.col("rev")).alias("revenue_text"))


# ------------------------------------------------------------------ C7 markdown
MD_ITEMS = [
    ("total_sales", "CAST(total_sales AS VARCHAR)"),
    ("avg_sales", "CAST(avg_sales AS VARCHAR)"),
    ("next_month_forecast", "CAST(next_month_forecast AS VARCHAR)"),
    ("forecast_range", "forecast_range"),
    ("growth_display", "growth_display"),
    ("trend", "trend"),
    ("trend_strength", "trend_strength"),
    ("forecast_confidence", "forecast_confidence"),
    ("risk_indicator", "risk_indicator"),
    ("best_month", "best_month"),
    ("worst_month", "worst_month"),
]


def markdown_sql() -> str:
    head = ["'# Automated Analytics Report: sales.csv'", "''", "'- Job ID: `job`'",
            "'- Operation: `forecasting`'", "'- Status: `SUCCEEDED`'", "''", "'## Key Metrics'"]
    head += [f"'- {k}: ' || COALESCE({v}, 'None')" for k, v in MD_ITEMS]
    n = len(head)
    n_ins = sum(1 for s, _ in FORECAST_LINES if s == "insight")
    rows = [(i, e) for i, e in enumerate(head)]
    rows += [(n, "''"), (n + 1, "'## Insights'")]
    rows += [(n + 2 + i, "'- ' || " + e) for i, (s, e) in enumerate(x for x in FORECAST_LINES if x[0] == "insight")]
    rows += [(n + 2 + n_ins, "''"), (n + 3 + n_ins, "'## Recommendations'")]
    rows += [(n + 4 + n_ins + i, "'- ' || " + e) for i, (s, e) in
             enumerate(x for x in FORECAST_LINES if x[0] == "recommendation")]
    body = "\nUNION ALL\n".join(f"SELECT CAST({o} AS INTEGER) AS ord, {e} AS line FROM m" for o, e in rows)
    return sql(FORECAST_BASE + "\n" + body)


@register("markdown_report", markdown_sql())
def q_markdown_report(spark, sf_dir):
    return reports.markdown_lines(processed(spark, sf_dir), operation="forecasting")


# ------------------------------------------------------------------ N10: calendar-period grain
@register("year_month_growth", sql(""", ms AS (SELECT strftime(date, '%Y-%m') AS period, SUM(units_sold) AS total_units
                FROM processed GROUP BY 1),
g AS (SELECT period, total_units, lag(total_units) OVER (ORDER BY period) AS previous_units FROM ms)
SELECT period, total_units, previous_units,
       CASE WHEN previous_units = 0 THEN NULL ELSE total_units / previous_units - 1 END AS growth
FROM g WHERE previous_units IS NOT NULL"""))
def q_year_month_growth(spark, sf_dir):
    from ..operators import forecast as fc
    return fc.month_growth(fc.monthly_totals(processed(spark, sf_dir), grain="year_month"))


# ------------------------------------------------------------------ A18
@register("fallback_totals", sql(
    "SELECT COALESCE(SUM(units_sold), 0.0) AS total_units, COALESCE(round(AVG(units_sold), 2), 0.0) AS avg_units FROM processed"))
def q_fallback_totals(spark, sf_dir):
    from ..operators.metrics import fallback_totals
    return fallback_totals(processed(spark, sf_dir))
