"""Composite outputs (C2-C8) built from the operators.

Each report is a set of small DataFrames derived from ONE processed table:
the heavy work is a handful of keyed aggregations (months, categories,
regions) that Spark partially aggregates map-side; every later step
(rankings, rules, sentences) runs on those aggregates, whose size is the key
domain. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import (
    BUSINESS_FIXED_RECOMMENDATIONS,
    BUSINESS_SPREAD_INSIGHT,
    FORECAST_CLOSING_INSIGHT,
    FORECAST_RECOMMENDATIONS,
    GAP_UNBALANCED,
    HEALTH_STABLE,
    HEALTH_UNBALANCED,
    NO_CONFIDENCE_INSIGHT,
    NO_GROWTH_INSIGHT,
    NO_TREND_INSIGHT,
    NOT_AVAILABLE,
    OPERATIONS,
    PREPROCESSING_NOTES,
    PRICE_CANDIDATES,
    REPORT_GAP_STABLE,
    REPORT_HEALTH_STABLE,
    REPORT_HEALTH_VARIANCE,
    SHARE_DOMINANT,
    SHARE_WEAK,
)
from ..functions.text import (
    currency_text,
    filled,
    forecast_range_text,
    growth_text,
    month_name,
    python_number_text,
    rewrite_month_numbers,
)
from ..operators import forecast as fc
from ..operators import metrics, ranking
from ..operators.quality import check_analytics_columns


def _num(c: Column) -> Column:
    return python_number_text(c)


def _lines(section: str, texts: list[Column]) -> Column:
    """Array of (section, text) structs; NULL texts are dropped."""
    arr = F.array(*[F.struct(F.lit(section).alias("section"), t.alias("text")) for t in texts])
    return F.filter(arr, lambda s: s["text"].isNotNull())


def explode_lines(one_row: DataFrame, *arrays: Column) -> DataFrame:
    """One-row frame with arrays of (section, text) -> rows (section, ord, text)."""
    allc = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    e = one_row.select(F.posexplode(allc).alias("_pos", "_l"))
    return e.select(F.col("_l.section").alias("section"), (F.col("_pos") + 1).cast("int").alias("ord"),
                    F.col("_l.text").alias("text"))


# ================================================================== R5 / R6 / A13
def gap_health(keyed: DataFrame) -> DataFrame:
    """(performance_gap, business_health, report_health) from category sums."""
    g = metrics.performance_gap(keyed)
    gap = F.col("performance_gap")
    return g.select(
        "performance_gap",
        F.when(gap > GAP_UNBALANCED, F.lit(HEALTH_UNBALANCED)).otherwise(F.lit(HEALTH_STABLE)).alias("business_health"),
        F.when(gap < REPORT_GAP_STABLE, F.lit(REPORT_HEALTH_STABLE)).otherwise(F.lit(REPORT_HEALTH_VARIANCE)).alias("report_health"),
    )


# ================================================================== C2 forecasting
def _cube(processed: DataFrame, cube: DataFrame | None, fallback: str = "units",
          candidates: list[str] | None = None) -> DataFrame:
    return cube if cube is not None else metrics.report_cube(metrics.with_revenue(processed, fallback=fallback, candidates=candidates))


def check_operation(operation: str) -> str:
    """Reject a mode that no report knows."""
    if operation not in OPERATIONS:
        raise ValueError(f"Unsupported operation: {operation!r}; expected one of {OPERATIONS}")
    return operation


def run_operation(processed: DataFrame, operation: str, **filters) -> dict[str, DataFrame]:
    """Every output of one mode: ``forecasting`` (C2) or ``business_analysis``."""
    if check_operation(operation) == "forecasting":
        return forecast_report(processed)
    return business_report(processed, **filters)


def _totals(cube: DataFrame) -> DataFrame:
    t = metrics.cube_totals(cube)
    return t.select(F.col("total_units").cast("bigint").alias("total_sales"),
                    F.round(F.try_divide(F.col("total_units"), F.col("n_units")), 2).alias("avg_sales"))


def _monthly(cube: DataFrame, grain: str) -> DataFrame:
    if grain == "month":
        return metrics.cube_keyed(cube, "month").withColumnRenamed("month", "period")
    if grain == "year_month":
        return metrics.cube_keyed(cube, "year_month")
    raise ValueError(f"unknown grain {grain!r}")


def forecast_metrics(processed: DataFrame, grain: str = "month", cube: DataFrame | None = None) -> DataFrame:
    """One row with the forecast KPI block plus ``status``.

    All inputs come from the report cube (one scan of ``processed``).
    Degenerate histories (one period, or growth after a zero period) give a
    row with NULL growth-derived fields and a status, never an exception.
    """
    cube = _cube(processed, cube)
    monthly = _monthly(cube, grain)
    summary = fc.growth_summary(monthly)
    bw = ranking.best_worst(monthly, "period")
    top = ranking.top_k(monthly, "period", 3).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "period"))),
                                 lambda s: s["period"].cast("string")), ", ").alias("top_months"))
    tot = _totals(cube)
    g = F.col("avg_growth")
    nxt = F.round(fc.compound(F.col("last_units"), g, F.lit(1)), 2)
    name = month_name if grain == "month" else (lambda c: c.cast("string"))
    return (tot.crossJoin(summary).crossJoin(bw).crossJoin(top)
            .select(
                "total_sales", "avg_sales",
                nxt.alias("next_month_forecast"),
                forecast_range_text(nxt).alias("forecast_range"),
                growth_text(g).alias("growth_display"),
                fc.trend(g).alias("trend"),
                fc.strength(g).alias("trend_strength"),
                fc.confidence(g).alias("forecast_confidence"),
                fc.risk(g).alias("risk_indicator"),
                name(F.col("best_period")).alias("best_month"),
                name(F.col("worst_period")).alias("worst_month"),
                "avg_growth", "top_months", "status",
            ))


def forecast_narrative(processed: DataFrame, grain: str = "month", cube: DataFrame | None = None) -> DataFrame:
    """R9 + R11: (section, ord, text) — 7 insights then 4 recommendations.

    A history too short for growth, or with undefined growth, states so in
    the same places; no sentence is left out.
    """
    m = forecast_metrics(processed, grain, cube)
    g = F.col("avg_growth")

    def known(column: str) -> Column:
        return F.when(F.length(column) > 0, F.col(column)).otherwise(F.lit(NOT_AVAILABLE))

    insights = _lines("insight", [
        F.coalesce(filled(config.FORECAST_TREND_INSIGHT, trend=F.col("trend")), F.lit(NO_TREND_INSIGHT)),
        F.coalesce(filled(config.FORECAST_GROWTH_INSIGHT, growth=_num(F.round(g * 100, 2))), F.lit(NO_GROWTH_INSIGHT)),
        filled(config.FORECAST_BEST_INSIGHT, best=known("best_month")),
        filled(config.FORECAST_WORST_INSIGHT, worst=known("worst_month")),
        filled(config.FORECAST_PEAK_INSIGHT, months=known("top_months")),
        F.coalesce(filled(config.FORECAST_CONFIDENCE_INSIGHT, confidence=F.col("forecast_confidence")), F.lit(NO_CONFIDENCE_INSIGHT)),
        F.lit(FORECAST_CLOSING_INSIGHT),
    ])
    recs = _lines("recommendation", [F.lit(t) for t in FORECAST_RECOMMENDATIONS])
    return explode_lines(m, insights, recs)


def forecast_report(processed: DataFrame, grain: str = "month") -> dict[str, DataFrame]:
    """Every output of the forecasting mode as DataFrames (one scan)."""
    check_analytics_columns(processed)
    cube = _cube(processed, None)
    monthly = _monthly(cube, grain)
    return {
        "metrics": forecast_metrics(processed, grain, cube),
        "monthly_sales": ranking.sort_by_key(monthly, "period"),
        "forecast": fc.forecast_steps(fc.growth_summary(monthly)),
        "narrative": forecast_narrative(processed, grain, cube),
    }


# ================================================================== C3 business analysis
def _business_base(processed: DataFrame, category="all", region="all", year="all") -> DataFrame:
    check_analytics_columns(processed)
    return metrics.with_revenue(metrics.apply_filters(processed, category, region, year), fallback="units")


def business_metrics(processed: DataFrame, category="all", region="all", year="all",
                     cube: DataFrame | None = None) -> DataFrame:
    """One row — totals, top/lowest keys, counts, gap, health, and the
    shares of the top/lowest keys used by the narrative (all from the cube)."""
    if cube is None:
        cube = metrics.report_cube(_business_base(processed, category, region, year))
    cat = metrics.cube_shares(cube, "category")
    reg = metrics.cube_shares(cube, "region")
    tot = _totals(cube)

    def best(keyed, key, prefix):
        return keyed.agg(
            F.min_by(F.col(key), F.struct(-F.col("total_units"), F.col(key))).alias(f"top_{prefix}"),
            F.min_by(F.col(key), F.struct(F.col("total_units"), F.col(key))).alias(f"lowest_{prefix}"),
            F.min_by(F.col("share_pct"), F.struct(-F.col("total_units"), F.col(key))).alias(f"top_{prefix}_share"),
            F.min_by(F.col("share_pct"), F.struct(F.col("total_units"), F.col(key))).alias(f"lowest_{prefix}_share"),
            F.count(F.lit(1)).alias(f"{prefix}_count"),
            F.coalesce(F.max("total_units") - F.min("total_units"), F.lit(0.0)).alias(f"{prefix}_gap"),
        )

    c = best(cat, "category", "category")
    r = best(reg, "region", "region")
    gap = F.col("category_gap")
    return tot.crossJoin(c).crossJoin(r).select(
        "total_sales", "avg_sales",
        F.coalesce(F.col("top_category"), F.lit(NOT_AVAILABLE)).alias("top_category"),
        F.coalesce(F.col("top_region"), F.lit(NOT_AVAILABLE)).alias("top_region"),
        "category_count", "region_count",
        gap.cast("double").alias("performance_gap"),
        F.when(gap > GAP_UNBALANCED, F.lit(HEALTH_UNBALANCED)).otherwise(F.lit(HEALTH_STABLE)).alias("business_health"),
        F.coalesce(F.col("lowest_category"), F.lit(NOT_AVAILABLE)).alias("lowest_category"),
        F.coalesce(F.col("lowest_region"), F.lit(NOT_AVAILABLE)).alias("lowest_region"),
        "top_category_share", "lowest_category_share", "top_region_share", "lowest_region_share",
    )


def business_narrative(processed: DataFrame, category="all", region="all", year="all",
                       cube: DataFrame | None = None) -> DataFrame:
    """R10 + R12: (section, ord, text) — insights (6 + up to 2 conditional)
    then 6 recommendations."""
    m = business_metrics(processed, category, region, year, cube)

    def share(c):
        return F.coalesce(_num(F.col(c)), F.lit("0"))

    tc, lc, tr, lr = (F.col("top_category"), F.col("lowest_category"),
                      F.col("top_region"), F.col("lowest_region"))
    insights = _lines("insight", [
        filled(config.BUSINESS_TOP_CATEGORY_INSIGHT, category=tc, share=share("top_category_share")),
        filled(config.BUSINESS_LOW_CATEGORY_INSIGHT, category=lc, share=share("lowest_category_share")),
        filled(config.BUSINESS_TOP_REGION_INSIGHT, region=tr, share=share("top_region_share")),
        filled(config.BUSINESS_LOW_REGION_INSIGHT, region=lr, share=share("lowest_region_share")),
        filled(config.BUSINESS_GAP_INSIGHT, gap=F.col("performance_gap").cast("bigint").cast("string")),
        F.lit(BUSINESS_SPREAD_INSIGHT),
        F.when(F.coalesce(F.col("top_category_share"), F.lit(0.0)) > SHARE_DOMINANT,
               filled(config.BUSINESS_DOMINANT_INSIGHT, category=tc)),
        F.when(F.coalesce(F.col("lowest_category_share"), F.lit(0.0)) < SHARE_WEAK,
               filled(config.BUSINESS_WEAK_INSIGHT, category=lc)),
    ])
    recs = _lines("recommendation", [
        filled(config.BUSINESS_INVEST_RECOMMENDATION, category=tc),
        filled(config.BUSINESS_IMPROVE_RECOMMENDATION, category=lc),
        filled(config.BUSINESS_EXPAND_RECOMMENDATION, region=tr),
        filled(config.BUSINESS_INVESTIGATE_RECOMMENDATION, region=lr),
    ] + [F.lit(t) for t in BUSINESS_FIXED_RECOMMENDATIONS])
    return explode_lines(m, insights, recs)


def business_report(processed: DataFrame, category="all", region="all", year="all") -> dict[str, DataFrame]:
    """Every output of the business-analysis mode as DataFrames."""
    df = _business_base(processed, category, region, year)
    cube = metrics.report_cube(df)
    cat = metrics.cube_shares(cube, "category")
    reg = metrics.cube_shares(cube, "region")
    return {
        "metrics": business_metrics(processed, category, region, year, cube),
        "kpis": metrics.dual_kpis(df),
        "category_sales": cat,
        "region_sales": reg,
        "top_categories": ranking.top_k(cat, "category"),
        "low_categories": ranking.bottom_k(cat, "category"),
        "region_ranking": ranking.ranking(reg, "region"),
        "monthly_sales": metrics.cube_keyed(cube, "month"),
        "dropdowns": metrics.dropdown_values(df),
        "narrative": business_narrative(processed, category, region, year, cube),
    }


# ================================================================== C4 dashboard
def dashboard_kpis(processed: DataFrame, cube: DataFrame | None = None) -> DataFrame:
    """KPI tiles: total and mean units, top category and region (ties -> smaller key)."""
    cube = _cube(processed, cube)
    tot = _totals(cube)
    c = metrics.cube_keyed(cube, "category").agg(metrics.arg_max("category").alias("top_category"))
    r = metrics.cube_keyed(cube, "region").agg(metrics.arg_max("region").alias("top_region"))
    return tot.crossJoin(c).crossJoin(r)


def dashboard_series(processed: DataFrame, cube: DataFrame | None = None) -> DataFrame:
    """(chart, label, value): monthly periods, categories, regions — key order
    is carried by ``label`` (ascending)."""
    cube = _cube(processed, cube)
    m = metrics.cube_keyed(cube, "year_month").select(F.lit("monthly").alias("chart"),
                                                       F.col("period").alias("label"), F.col("total_units").alias("value"))
    c = metrics.cube_keyed(cube, "category").select(F.lit("category").alias("chart"),
                                                 F.col("category").alias("label"), F.col("total_units").alias("value"))
    r = metrics.cube_keyed(cube, "region").select(F.lit("region").alias("chart"),
                                               F.col("region").alias("label"), F.col("total_units").alias("value"))
    return m.unionByName(c).unionByName(r)


# ================================================================== C5 results view
def results_view(processed: DataFrame, category="all", region="all", year="all") -> DataFrame:
    """Filtered units/revenue KPIs (results-page revenue rule: no price -> 0)
    next to the dropdown lists of the unfiltered table, as JSON arrays.

    The lists come from ``dropdown_values``: one row per key value.
    """
    k = metrics.filtered_kpis(processed, category, region, year, fallback="zero")
    values = metrics.dropdown_values(processed)

    def listed(kind: str, cast: str = "string") -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "value"))))
        return F.to_json(F.transform(own, lambda v: v["value"].cast(cast)))

    lists = values.agg(listed("category").alias("category_list"), listed("region").alias("region_list"), listed("year", "int").alias("year_list"))
    return k.crossJoin(lists)


# ================================================================== C6 report document
def report_document(processed: DataFrame, operation: str = "business_analysis",
                    filename: str = "sales.csv") -> DataFrame:
    """(section, ord, text): overview, preprocessing, key metrics, distribution,
    insights (month numbers rewritten to names), recommendations, KPI tiles.
    Always recomputed from the processed table (no cached fallbacks); revenue
    takes the first price column that the table has."""
    check_operation(operation)
    cube = _cube(processed, None, fallback="zero", candidates=PRICE_CANDIDATES)
    t = metrics.cube_totals(cube)
    shape = t.select(F.col("n_rows").alias("row_count"),
                     F.round(F.coalesce(F.col("total_revenue"), F.lit(0)), 2).cast("double").alias("total_revenue"),
                     F.round(F.try_divide(F.col("total_revenue"), F.col("n_revenue")), 2).cast("double").alias("avg_revenue"))
    ncols = len(processed.columns)
    b = business_metrics(processed, cube=cube)
    one = shape.crossJoin(b)
    title = _lines("title", [F.lit(f"Analytics Report: {filename}")])
    summary = _lines("executive_summary", [
        F.concat(F.lit("Processed "), F.col("row_count").cast("string"), F.lit(f" rows using {operation} mode."))])
    overview = _lines("dataset_overview", [
        F.concat(F.lit("Rows used in analysis: "), F.col("row_count").cast("string")),
        F.lit(f"Columns found in dataset: {ncols}"),
        F.concat(F.lit("Categories: "), F.col("category_count").cast("string")),
        F.concat(F.lit("Regions: "), F.col("region_count").cast("string")),
    ])
    prep = _lines("preprocessing", [F.lit(t) for t in PREPROCESSING_NOTES])
    gap = F.col("performance_gap")
    keym = _lines("key_metrics", [
        F.concat(F.lit("Total Sales: "), F.col("total_sales").cast("string")),
        F.concat(F.lit("Average Sales: "), _num(F.col("avg_sales"))),
        F.concat(F.lit("Top Category: "), F.col("top_category")),
        F.concat(F.lit("Top Region: "), F.col("top_region")),
        F.concat(F.lit("Category Count: "), F.col("category_count").cast("string")),
        F.concat(F.lit("Region Count: "), F.col("region_count").cast("string")),
        F.concat(F.lit("Performance Gap: "), gap.cast("bigint").cast("string")),
        F.when(gap < REPORT_GAP_STABLE, F.lit(REPORT_HEALTH_STABLE)).otherwise(F.lit(REPORT_HEALTH_VARIANCE)),
    ])
    dist = _lines("sales_distribution", [
        F.concat(F.lit("Top Category: "), F.col("top_category")),
        F.concat(F.lit("Top Region: "), F.col("top_region")),
        F.concat(F.lit("Lowest Category: "), F.col("lowest_category")),
    ])
    kpis = _lines("kpis", [
        F.concat(F.lit("Total Sales: "), F.col("total_sales").cast("string")),
        F.concat(F.lit("Average Sales: "), _num(F.col("avg_sales"))),
        F.concat(F.lit("Total Revenue: "), currency_text(F.col("total_revenue"))),
        F.concat(F.lit("Avg Revenue: "), currency_text(F.col("avg_revenue"))),
    ])
    head = explode_lines(one, title, summary, overview, prep, keym, dist, kpis)
    narrative = (forecast_narrative(processed, cube=cube) if operation == "forecasting"
                 else business_narrative(processed, cube=cube))
    narrative = narrative.select(
        F.concat(F.col("section"), F.lit("s")).alias("section"), "ord",
        rewrite_month_numbers(F.col("text")).alias("text"))
    return head.unionByName(narrative)


# ================================================================== C7 markdown
def markdown_lines(processed: DataFrame, operation: str = "forecasting", job_id: str = "job",
                   filename: str = "sales.csv", status: str = "SUCCEEDED") -> DataFrame:
    """(ord, line) of the markdown report; ``write.text`` or ``array_join`` to render."""
    check_operation(operation)
    cube = _cube(processed, None)
    if operation == "forecasting":
        m = forecast_metrics(processed, cube=cube)
        items = [("total_sales", F.col("total_sales").cast("string")),
                 ("avg_sales", _num(F.col("avg_sales"))),
                 ("next_month_forecast", _num(F.col("next_month_forecast"))),
                 ("forecast_range", F.col("forecast_range")),
                 ("growth_display", F.col("growth_display")),
                 ("trend", F.col("trend")), ("trend_strength", F.col("trend_strength")),
                 ("forecast_confidence", F.col("forecast_confidence")),
                 ("risk_indicator", F.col("risk_indicator")),
                 ("best_month", F.col("best_month")), ("worst_month", F.col("worst_month"))]
        narrative = forecast_narrative(processed, cube=cube)
    else:
        m = business_metrics(processed, cube=cube)
        items = [("total_sales", F.col("total_sales").cast("string")),
                 ("avg_sales", _num(F.col("avg_sales"))),
                 ("top_category", F.col("top_category")), ("top_region", F.col("top_region")),
                 ("category_count", F.col("category_count").cast("string")),
                 ("region_count", F.col("region_count").cast("string")),
                 ("performance_gap", _num(F.col("performance_gap"))),
                 ("business_health", F.col("business_health"))]
        narrative = business_narrative(processed, cube=cube)
    head = [F.lit(f"# Automated Analytics Report: {filename}"), F.lit(""),
            F.lit(f"- Job ID: `{job_id}`"), F.lit(f"- Operation: `{operation}`"),
            F.lit(f"- Status: `{status}`"), F.lit(""), F.lit("## Key Metrics")]
    head += [F.concat(F.lit(f"- {k}: "), F.coalesce(v, F.lit("None"))) for k, v in items]
    top = m.select(F.posexplode(F.array(*head)).alias("ord", "line"))
    n_head = len(head)
    # narrative blocks: blank + heading + bullets, numbered after the head.
    # Narrative ordinals run 1..n over insights then n+1..n+m over recommendations.
    ins = narrative.filter(F.col("section") == "insight")
    rec = narrative.filter(F.col("section") == "recommendation")
    n_ins = ins.agg(F.count(F.lit(1)).alias("n"))
    ins_lines = ins.select((F.col("ord") + n_head + 1).alias("ord"), F.concat(F.lit("- "), F.col("text")).alias("line"))
    rec_lines = rec.select((F.col("ord") + n_head + 3).alias("ord"), F.concat(F.lit("- "), F.col("text")).alias("line"))
    sep = n_ins.select(F.explode(F.array(
        F.struct(F.lit(n_head).alias("ord"), F.lit("").alias("line")),
        F.struct(F.lit(n_head + 1).alias("ord"), F.lit("## Insights").alias("line")),
        F.struct((F.lit(n_head + 2) + F.col("n")).alias("ord"), F.lit("").alias("line")),
        F.struct((F.lit(n_head + 3) + F.col("n")).alias("ord"), F.lit("## Recommendations").alias("line")),
    )).alias("s")).select("s.ord", "s.line")
    return (top.unionByName(sep).unionByName(ins_lines).unionByName(rec_lines)
            .select(F.col("ord").cast("int").alias("ord"), "line"))


# ================================================================== C8 BI dataset
def bi_dataset(kept: DataFrame, cleaned: DataFrame) -> dict[str, DataFrame]:
    """KPI card, trend line and anomaly table for a BI tool, as tables."""
    from ..operators.clean import outlier_anomalies

    rev = metrics.with_revenue(kept)
    return {
        "kpi_card": metrics.dual_kpis(rev),
        "trend_line": metrics.units_by_year_month(kept),
        "anomaly_table": outlier_anomalies(cleaned, "units_sold"),
    }
