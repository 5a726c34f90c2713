"""Growth and compounding forecast over monthly totals.

Everything here runs on the monthly aggregate (at most 12 rows for the
calendar-month grain), so the un-partitioned month window is bounded by
construction; the heavy pass is the distributed ``groupBy(month)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    CONFIDENCE_LOW,
    CONFIDENCE_MEDIUM,
    FORECAST_STEPS,
    RISK_DECLINING,
    RISK_STABLE,
    STRENGTH_STRONG,
    TREND_DOWN,
    TREND_UP,
)
from .metrics import keyed_sum


def monthly_totals(df: DataFrame, grain: str = "month") -> DataFrame:
    """(period, total_units). ``grain="month"`` merges years into months 1-12
    (the original behaviour); ``grain="year_month"`` keeps calendar periods."""
    if grain == "month":
        return keyed_sum(df, "month", name="period")
    if grain == "year_month":
        return keyed_sum(df, F.date_format("date", "yyyy-MM"), name="period")
    raise ValueError(f"unknown grain {grain!r}")


def month_growth(monthly: DataFrame, key: str = "period") -> DataFrame:
    """Period-over-period change ``s / previous - 1``; the first period has
    none and is dropped. A zero previous total gives NULL, not an error."""
    w = Window.orderBy(F.col(key))
    prev = F.lag("total_units").over(w)
    g = monthly.select(key, "total_units", prev.alias("previous_units"))
    return (g.filter(F.col("previous_units").isNotNull())
            .withColumn("growth", F.try_divide(F.col("total_units"), F.col("previous_units")) - F.lit(1.0)))


def growth_summary(monthly: DataFrame, key: str = "period") -> DataFrame:
    """One row (n_periods, avg_growth, last_units, status).

    ``status`` is ``ok``; ``insufficient_history`` with fewer than two
    periods; ``undefined_growth`` when a previous period totals 0 (the
    change is infinite). ``avg_growth`` is NULL unless the status is ``ok``.
    """
    growth = month_growth(monthly, key)
    g = growth.agg(F.avg("growth").alias("_avg"), F.count_if(F.col("growth").isNull()).alias("_undef"))
    base = monthly.agg(F.count(F.lit(1)).alias("n_periods"),
                       F.max_by("total_units", key).alias("last_units"))
    status = (F.when(F.col("n_periods") < 2, F.lit("insufficient_history"))
              .when(F.col("_undef") > 0, F.lit("undefined_growth"))
              .otherwise(F.lit("ok")))
    return (base.crossJoin(g)
            .select("n_periods", F.when(status == "ok", F.col("_avg")).alias("avg_growth"),
                    "last_units", status.alias("status")))


def compound(start: Column, growth: Column, step: Column) -> Column:
    """``start * (1+g)`` applied ``step`` times, one multiplication at a time
    (the same floating-point sequence as an iterative loop)."""
    return F.aggregate(F.sequence(F.lit(1), step), start.cast("double"),
                       lambda acc, _: acc * (F.lit(1.0) + growth))


def forecast_steps(summary: DataFrame, steps: int = FORECAST_STEPS) -> DataFrame:
    """(step, label, forecast) for ``Month+1`` .. ``Month+steps``, 2 dp."""
    s = summary.select("last_units", "avg_growth",
                       F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return s.select(
        "step",
        F.concat(F.lit("Month+"), F.col("step").cast("string")).alias("label"),
        F.round(compound(F.col("last_units"), F.col("avg_growth"), F.col("step")), 2).alias("forecast"),
    )


# ---------------------------------------------------------------- R1-R4
def trend(g: Column) -> Column:
    return F.when(g.isNull(), F.lit(None)).when(g > 0, F.lit(TREND_UP)).otherwise(F.lit(TREND_DOWN))


def confidence(g: Column) -> Column:
    a = F.abs(g)
    return (F.when(g.isNull(), F.lit(None)).when(a < CONFIDENCE_LOW, F.lit("Low"))
            .when(a < CONFIDENCE_MEDIUM, F.lit("Medium")).otherwise(F.lit("High")))


def strength(g: Column) -> Column:
    return (F.when(g.isNull(), F.lit(None)).when(g > STRENGTH_STRONG, F.lit("Strong Growth"))
            .when(g > 0, F.lit("Moderate Growth")).when(g > -STRENGTH_STRONG, F.lit("Moderate Decline"))
            .otherwise(F.lit("Strong Decline")))


def risk(g: Column) -> Column:
    return F.when(g.isNull(), F.lit(None)).when(g < 0, F.lit(RISK_DECLINING)).otherwise(F.lit(RISK_STABLE))
