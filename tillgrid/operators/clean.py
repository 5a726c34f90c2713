"""Cleaning operators (DataFrame -> DataFrame), in pipeline order.

Every operator is lazy, but for the exact fence, whose brackets (a row per group) are
found by jobs that run at once. Schema-level decisions (which
columns exist, what type they have) are made on the driver from
``df.schema``, which costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from ..config import (
    DATE_FORMATS,
    EXTRA_NUMERIC_COLUMNS,
    FENCE_HIGH_Q,
    FENCE_K,
    FENCE_LOW_Q,
    NA_TOKENS,
    NUMERIC_COLUMNS,
)
from ..functions.dates import date_text, day_of, iso_week, month_of, weekday_monday0, with_day_by_shape, year_of
from ..functions.numbers import coerce_number, finite, literal_number
from ..functions.text import promotion_flag
from .joins import counted_broadcast, one_row
from .quantiles import exact_quantiles, written


# ---------------------------------------------------------------- P1 / N4
def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row de-duplication. Partial aggregation collapses copies map-side,
    so even a group of copies holding a large share of the rows costs one
    row per task before the shuffle."""
    return df.dropDuplicates()


def null_na_tokens(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Text cells equal to a missing-value token become NULL (all text columns)."""
    toks = tokens if tokens is not None else NA_TOKENS
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            c = F.when(c.isin(*toks), F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(field.name))
    return df.select(*cols)


# ---------------------------------------------------------------- P2 / P3
def normalise_name(name: str) -> str:
    return name.replace("﻿", "").strip().lower().replace(" ", "_").replace("/", "_")


def normalise_headers(df: DataFrame) -> DataFrame:
    """strip -> lower -> space to ``_`` -> slash to ``_``; collisions raise."""
    names = [normalise_name(c) for c in df.columns]
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise ValueError(f"Column names collide after normalisation: {dupes}")
    return df.toDF(*names)


def lenient_headers(df: DataFrame) -> DataFrame:
    """Re-read form: strip + lower only, then ``units sold`` -> ``units_sold``."""
    names = [c.replace("﻿", "").strip().lower() for c in df.columns]
    out = df.toDF(*names)
    if "units sold" in names and "units_sold" not in names:
        out = out.withColumnRenamed("units sold", "units_sold")
    return out


# ---------------------------------------------------------------- P4 / P5
def _with_day(df: DataFrame, column: str, day: str, formats: list[str] | None = None) -> DataFrame:
    """``df`` with the parsed date of ``column`` as ``day``."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        return df.withColumn(day, F.col(column).cast("date"))
    return with_day_by_shape(df, date_text(F.col(column)), day, formats or DATE_FORMATS)


def parse_dates(df: DataFrame, column: str = "date", formats: list[str] | None = None) -> DataFrame:
    """Coerce ``column`` to DATE; unparsable -> NULL. A time of day behind the date is cut off."""
    parsed = _with_day(df, column, "_day", formats)
    return parsed.withColumn(column, F.col("_day")).drop("_day")


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def rejected_rows(raw: DataFrame, date: str = "date", target: str = "units_sold") -> DataFrame:
    """The rows that cleaning drops, as they came, with ``reason`` (``missing_date``,
    ``invalid_date``, ``missing_target``, ``invalid_target``; a date fault counts first)."""

    def blank(name: str) -> Column:
        return F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")

    bad_date = F.when(blank(date), "missing_date").when(F.col("_day").isNull(), "invalid_date")
    bad_target = F.when(blank(target), "missing_target").when(coerce_number(F.col(target), raw.schema[target].dataType).isNull(), "invalid_target")
    dated = _with_day(raw, date, "_day")
    return dated.withColumn("reason", F.coalesce(bad_date, bad_target)).drop("_day").where(F.col("reason").isNotNull())


# ---------------------------------------------------------------- P6 / P7
def coerce_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Coerce measure columns to DOUBLE; invalid -> NULL. Missing columns are skipped.

    Text cells are coerced as one array, so the code that Spark makes of the stage stays
    short enough to be compiled when dates are parsed in it too.
    """
    wanted = columns if columns is not None else NUMERIC_COLUMNS + EXTRA_NUMERIC_COLUMNS
    present = [c for c in wanted if c in df.columns]
    text = [c for c in present if isinstance(df.schema[c].dataType, StringType)]
    out = df.withColumns({c: coerce_number(F.col(c), df.schema[c].dataType) for c in present if c not in text})
    if not text:
        return out
    out = out.withColumn("_numbers", F.transform(F.array(*[F.col(c) for c in text]), literal_number))
    return out.withColumns({c: finite(F.col("_numbers")[i]) for i, c in enumerate(text)}).drop("_numbers")


# ---------------------------------------------------------------- A12 / P8 / P9
def fence_bounds(df: DataFrame, column: str = "units_sold", k: float = FENCE_K,
                 approx: bool = False, accuracy: int = 100000, by: list[str] | None = None) -> DataFrame:
    """One row (q1, q3, iqr, lower, upper) over the whole input, or one per group.

    Quartiles are exact with linear interpolation (``quantiles.exact_quantiles``);
    ``approx=True`` takes a bounded sketch's quartiles instead.
    """
    keys = by or []
    if approx:
        c = F.percentile_approx(F.col(column), F.array(F.lit(FENCE_LOW_Q), F.lit(FENCE_HIGH_Q)), accuracy)
        q = df.groupBy(*keys).agg(c.alias("_q")).select(*keys, F.col("_q")[0].cast("double").alias("q1"), F.col("_q")[1].cast("double").alias("q3"))
    else:
        q = exact_quantiles(df, column, [FENCE_LOW_Q, FENCE_HIGH_Q], by=by).select(*keys, F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    q1, q3 = F.col("q1"), F.col("q3")
    return q.select(*keys, "q1", "q3", (q3 - q1).alias("iqr"), (q1 - F.lit(k) * (q3 - q1)).alias("lower"),
                    (q3 + F.lit(k) * (q3 - q1)).alias("upper"))


def fence_counts(df: DataFrame, column: str = "units_sold", k: float = FENCE_K) -> DataFrame:
    """One row: the fence's bounds and how many rows it keeps and rejects, counted in one pass."""
    c = F.col(column)
    both = df.select(c).crossJoin(one_row(fence_bounds(df, column, k)))
    bounds = [F.first(x).alias(x) for x in ("q1", "q3", "lower", "upper")]
    return both.agg(*bounds, F.count_if((c >= F.col("lower")) & (c <= F.col("upper"))).alias("kept"),
                    F.count_if((c < F.col("lower")) | (c > F.col("upper"))).alias("rejected"))


def _with_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    b = bounds.select(F.col("lower").alias("_fence_lower"), F.col("upper").alias("_fence_upper"))
    return df.crossJoin(one_row(b))


def _with_group_bounds(df: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    b = written(bounds.select(*by, F.col("lower").alias("_fence_lower"), F.col("upper").alias("_fence_upper")))
    return df.join(counted_broadcast(b, b.count()), by)


def outlier_fence(df: DataFrame, column: str = "units_sold", k: float = FENCE_K,
                  approx: bool = False, by: list[str] | None = None) -> DataFrame:
    """Keep rows with ``lower <= column <= upper`` (inclusive 1.5*IQR fence).

    The bounds are a one-row global aggregate joined back by broadcast; the
    big side is streamed, never shuffled. With ``by`` (e.g. one fence per
    uploaded job) the bounds are one row per group, joined on the group key
    (broadcast if they are few, so a group's rows don't all meet in one task).
    """
    b = fence_bounds(df, column, k, approx, by=by)
    c = F.col(column)
    joined = _with_group_bounds(df, b, by) if by else _with_bounds(df, b)
    return (joined
            .filter((c >= F.col("_fence_lower")) & (c <= F.col("_fence_upper")))
            .drop("_fence_lower", "_fence_upper"))


def outlier_anomalies(df: DataFrame, column: str = "units_sold", k: float = FENCE_K,
                      approx: bool = False) -> DataFrame:
    """The complement of the fence: rejected rows plus ``side`` ('low'/'high')
    and the bounds that rejected them (rows with a NULL measure are neither)."""
    b = fence_bounds(df, column, k, approx)
    c = F.col(column)
    out = _with_bounds(df, b).filter((c < F.col("_fence_lower")) | (c > F.col("_fence_upper")))
    return (out.withColumn("side", F.when(c < F.col("_fence_lower"), F.lit("low")).otherwise(F.lit("high")))
            .withColumnRenamed("_fence_lower", "fence_lower")
            .withColumnRenamed("_fence_upper", "fence_upper"))


# ---------------------------------------------------------------- P10 / F1-F4
def fill_discount(df: DataFrame) -> DataFrame:
    if "discount" not in df.columns:
        return df
    return df.withColumn("discount", F.coalesce(F.col("discount"), F.lit(0.0)))


def date_features(date: Column) -> dict[str, Column]:
    return {
        "year": year_of(date),
        "month": month_of(date),
        "day": day_of(date),
        "day_of_week": weekday_monday0(date),
        "week_of_year": iso_week(date),
    }


def add_features(df: DataFrame) -> DataFrame:
    """Calendar parts of ``date`` and the promotion flag."""
    cols = date_features(F.col("date"))
    if "holiday_promotion" in df.columns:
        cols["promotion_flag"] = promotion_flag(F.col("holiday_promotion"))
    return df.withColumns(cols)
