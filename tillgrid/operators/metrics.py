"""Filters, revenue and aggregations over the processed sales table.

Keyed sums drop NULL keys (a missing category is not a group) while totals
keep every row. Money is summed as fixed-point DECIMAL so totals do not
depend on partition order; doubles appear only at the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PRICE_CANDIDATES
from ..session import ensure_checkpoint_dir

ALL = "all"


# ---------------------------------------------------------------- P14-P17
def apply_filters(df: DataFrame, category: str = ALL, region: str = ALL, year=ALL) -> DataFrame:
    """Equality filters with an ``"all"`` sentinel; ``year`` only if the column exists.

    The predicates are plain comparisons, so they reach the Parquet scan as
    pushed filters (and prune ``year=`` partitions of a partitioned table).
    """
    wanted = {"category": category, "region": region, "year": year}
    out = df
    for column, value in wanted.items():
        if value != ALL and column in df.columns:
            out = out.filter(F.col(column) == F.lit(year_number(value) if column == "year" else value))
    return out


def year_number(year) -> int:
    try:
        return int(year)
    except (TypeError, ValueError) as exc:
        raise ValueError(f"year filter must be an integer, got {year!r}") from exc


# ---------------------------------------------------------------- P11-P13
def price_column(df: DataFrame, candidates: list[str] | None = None) -> str | None:
    for c in (candidates if candidates is not None else PRICE_CANDIDATES):
        if c in df.columns:
            return c
    return None


def with_revenue(df: DataFrame, fallback: str = "units", candidates: list[str] | None = None) -> DataFrame:
    """``revenue = units_sold * price``.

    Without a price column: ``fallback="units"`` uses units as revenue (the
    analysis mode), ``fallback="zero"`` uses 0 (the results view).
    ``candidates`` enables price-column detection (first present name wins);
    by default only ``price`` is looked for.
    """
    price = price_column(df, candidates if candidates is not None else ["price"])
    if price is not None and "units_sold" in df.columns:
        rev = F.col("units_sold") * F.col(f"`{price}`")
    elif fallback == "zero":
        rev = F.lit(0.0)
    elif fallback == "units" and "units_sold" in df.columns:
        rev = F.col("units_sold").cast("double")
    else:
        rev = F.lit(None).cast("double")
    return df.withColumn("revenue", rev.cast("double"))


def exact(col: Column) -> Column:
    """Fixed-point form of a measure for order-independent sums."""
    return col.cast("decimal(38,6)")


def mean(col: Column) -> Column:
    """Mean by an order-independent sum."""
    return F.try_divide(F.sum(exact(col)).cast("double"), F.count(col))


# ---------------------------------------------------------------- A1-A4, A15
def kpi_columns(units: str = "units_sold", revenue: str | None = "revenue") -> list[Column]:
    cols = [
        F.coalesce(F.sum(exact(F.col(units))), F.lit(0)).cast("bigint").alias("total_units"),
        F.round(mean(F.col(units)), 2).alias("avg_units"),
    ]
    if revenue:
        cols += [
            F.round(F.coalesce(F.sum(exact(F.col(revenue))), F.lit(0)), 2).cast("double").alias("total_revenue"),
            F.round(F.avg(exact(F.col(revenue))), 2).cast("double").alias("avg_revenue"),
        ]
    return cols


def dual_kpis(df: DataFrame) -> DataFrame:
    """One row: total/avg units and total/avg revenue (one aggregation)."""
    return df.agg(*kpi_columns())


def filtered_kpis(df: DataFrame, category: str = ALL, region: str = ALL, year=ALL,
                  fallback: str = "zero") -> DataFrame:
    """Filters, then the dual KPI block (results view)."""
    return dual_kpis(with_revenue(apply_filters(df, category, region, year), fallback=fallback))


# ---------------------------------------------------------------- A5-A8
def keyed_sum(df: DataFrame, key: str | Column, name: str | None = None,
              measure: str = "units_sold", keep_null_key: bool = False) -> DataFrame:
    """(key, total_units): partial sums map-side, one shuffle of one row per key per task."""
    k = F.col(key) if isinstance(key, str) else key
    kname = name or (key if isinstance(key, str) else "key")
    src = df if keep_null_key else df.filter(k.isNotNull())
    return src.groupBy(k.alias(kname)).agg(F.sum(exact(F.col(measure))).cast("double").alias("total_units"))


def units_by_month(df: DataFrame) -> DataFrame:
    return keyed_sum(df, "month")


def units_by_year_month(df: DataFrame) -> DataFrame:
    return keyed_sum(df, F.date_format("date", "yyyy-MM"), name="period")


def category_sales(df: DataFrame) -> DataFrame:
    return keyed_sum(df, "category")


def region_sales(df: DataFrame) -> DataFrame:
    return keyed_sum(df, "region")


# ---------------------------------------------------------------- A9 / A10
def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact distinct categories and regions (NULL excluded)."""
    return df.agg(F.countDistinct("category").alias("category_count"),
                  F.countDistinct("region").alias("region_count"))


def dropdown_values(df: DataFrame) -> DataFrame:
    """(kind, ord, value): sorted distinct categories, regions and years, from one scan.

    A row's three values are told apart by kind and made distinct with partial
    aggregation; the ordinal is a window per kind over the distinct values.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in ("category", "region", "year")])
    values = df.select(F.explode(kinds).alias("v")).select("v.kind", "v.value").where("value is not null").distinct()
    order = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "year", F.col("value").try_cast("int")), "value")
    return values.select("kind", F.row_number().over(order).alias("ord"), "value")


# ---------------------------------------------------------------- A11 / A13
def arg_max(key: str, value: str = "total_units") -> Column:
    """Key of the largest value; ties -> smallest key."""
    return F.min_by(F.col(key), F.struct(-F.col(value), F.col(key)))


def arg_min(key: str, value: str = "total_units") -> Column:
    """Key of the smallest value; ties -> smallest key."""
    return F.min_by(F.col(key), F.struct(F.col(value), F.col(key)))


def performance_gap(keyed: DataFrame) -> DataFrame:
    """max - min of the keyed sums; 0 when there are no groups."""
    return keyed.agg(F.coalesce(F.max("total_units") - F.min("total_units"), F.lit(0.0)).alias("performance_gap"))


# ---------------------------------------------------------------- A14
def shares(df: DataFrame, key: str) -> DataFrame:
    """(key, total_units, share_pct) with share = 100 * group / grand total.

    One aggregation including the NULL-key group; the grand total (which
    includes rows with a missing key) is a window sum over the aggregated
    groups, whose count is the key domain. The NULL group is dropped after.
    All shares are 0 when the total is 0.
    """
    g = keyed_sum(df, key, keep_null_key=True)
    total = F.sum("total_units").over(Window.partitionBy(F.lit(0)))
    pct = F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col("total_units") / total * 100, 2))
    return g.withColumn("share_pct", pct).filter(F.col(key).isNotNull())


# ---------------------------------------------------------------- A17 / A18
CUBE_KEYS = ["category", "region", "month", "year"]


def _cube(df: DataFrame, grains: dict[int, str], revenue: Column, empty_revenue: Column) -> DataFrame:
    """The grains named by their grouping id over ``CUBE_KEYS`` (bit set: rolled up).

    Raw rows are aggregated once to the finest grain (year, month, category,
    region), with partial aggregation; the grouping sets expand only those
    few rows.
    """
    fine = df.select(*CUBE_KEYS, exact(F.col("units_sold")).alias("_units"), revenue.alias("_rev")).groupBy(*CUBE_KEYS).agg(
        F.sum("_units").alias("_units"), F.count("_units").alias("_n_units"), F.sum("_rev").alias("_rev"),
        F.count("_rev").alias("_n_rev"), F.count(F.lit(1)).alias("_rows"))
    sets = [[F.col(k) for i, k in enumerate(CUBE_KEYS) if not g >> (len(CUBE_KEYS) - 1 - i) & 1] for g in grains]
    g = fine.groupingSets(sets, *CUBE_KEYS).agg(
        F.grouping_id().alias("_gid"),
        F.coalesce(F.sum("_units").cast("double"), F.lit(0.0)).alias("total_units"),
        F.coalesce(F.sum("_n_units"), F.lit(0)).alias("n_units"),
        F.coalesce(F.sum("_rev").cast("decimal(38,6)"), empty_revenue).alias("total_revenue"),
        F.coalesce(F.sum("_n_rev"), F.lit(0)).alias("n_revenue"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"))
    grain, keep = F.lit(None).cast("string"), F.lit(False)
    for gid, name in grains.items():
        keyed = F.col("_gid") == gid
        grain = F.when(keyed, F.lit(name)).otherwise(grain)
        for i, k in enumerate(CUBE_KEYS):
            if not gid >> (len(CUBE_KEYS) - 1 - i) & 1:
                keyed = keyed & F.col(k).isNotNull()
        keep = keep | keyed
    return g.withColumn("grain", grain).where(keep).drop("_gid")


def sales_cube(df: DataFrame) -> DataFrame:
    """Five grains: GROUPING SETS ((), (category), (region), (month), (year)).

    Carries sums and non-null counts (not averages) so any mean can be
    derived exactly from the cube. ``grain`` names the grouping set; rows of
    a keyed grain whose key is NULL are removed (the grand total keeps them).
    """
    rev = exact(F.col("revenue")) if "revenue" in df.columns else exact(F.col("units_sold") * F.col("price"))
    grains = {g: n for g, n in REPORT_GRAINS.items() if n != "year_month"}
    return _cube(df, grains, rev, F.lit(0).cast("decimal(38,6)"))


def fallback_totals(df: DataFrame) -> DataFrame:
    """Total and mean units, always recomputed from the data.

    The original takes a cached metric, else the sum of category sums, else
    the table; recomputing from the table gives the same number whenever the
    cache was right and is always defined.
    """
    return df.agg(F.coalesce(F.sum(exact(F.col("units_sold"))).cast("double"), F.lit(0.0)).alias("total_units"),
                  F.coalesce(F.round(mean(F.col("units_sold")), 2), F.lit(0.0)).alias("avg_units"))


# ---------------------------------------------------------------- report cube (A17 for the reports)
# grouping_id bits over (category, region, month, year); 1 = column rolled up
REPORT_GRAINS = {15: "all", 7: "category", 11: "region", 13: "month", 12: "year_month", 14: "year"}


def report_cube(df: DataFrame, materialise: bool = True) -> DataFrame:
    """Every aggregate a report needs, from ONE scan of the processed table.

    GROUPING SETS ((), (category), (region), (month), (year, month), (year))
    with units sum/count, exact revenue sum/count and row count. The result
    has one row per key value (a few hundred rows) and is checkpointed in the
    shared folder: every branch of the report reads those files, nothing
    stays cached in the session, and a lost executor costs nothing.
    """
    rev = exact(F.col("revenue")) if "revenue" in df.columns else F.lit(None).cast("decimal(38,6)")
    g = _cube(df, REPORT_GRAINS, rev, F.lit(None).cast("decimal(38,6)"))
    if not materialise:
        return g
    ensure_checkpoint_dir(df.sparkSession)
    return g.checkpoint()


def cube_keyed(cube: DataFrame, grain: str) -> DataFrame:
    """(key, total_units) slice of the report cube; ``year_month`` gets a ``period`` label."""
    s = cube.filter(F.col("grain") == grain)
    if grain == "year_month":
        label = F.date_format(F.make_date(F.col("year"), F.col("month"), F.lit(1)), "yyyy-MM")
        return s.select(label.alias("period"), "total_units")
    return s.select(grain, "total_units")


def cube_totals(cube: DataFrame) -> DataFrame:
    """The grand-total row: total_units, n_units, total_revenue, n_revenue, n_rows."""
    return cube.filter(F.col("grain") == "all").select("total_units", "n_units", "total_revenue", "n_revenue", "n_rows")


def cube_shares(cube: DataFrame, key: str) -> DataFrame:
    """(key, total_units, share_pct) with the grand total (NULL keys included) as base."""
    t = cube_totals(cube).select(F.col("total_units").alias("_t"))
    k = cube_keyed(cube, key)
    pct = F.when(F.col("_t") == 0, F.lit(0.0)).otherwise(F.round(F.col("total_units") / F.col("_t") * 100, 2))
    return k.crossJoin(F.broadcast(t)).select(key, "total_units", pct.alias("share_pct"))
