"""Validation and data-quality operators.

Schema checks run on the driver against ``df.schema`` (metadata only, no
job). Data checks are single aggregations: every rule of a report is one
expression inside ONE ``agg`` so the table is scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ANALYTICS_COLUMNS, NUMERIC_COLUMNS, REQUIRED_COLUMNS
from ..functions.numbers import coerce_number


# ---------------------------------------------------------------- V1 / V7
def missing_columns(df: DataFrame, required: list[str] | None = None) -> list[str]:
    req = required if required is not None else REQUIRED_COLUMNS
    return [c for c in req if c not in df.columns]


def check_schema(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Raise ``ValueError`` naming every missing required column."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def check_analytics_columns(df: DataFrame) -> DataFrame:
    """Raise on the first missing analytics column (units_sold, category, region)."""
    for c in ANALYTICS_COLUMNS:
        if c not in df.columns:
            raise ValueError(f"Missing required column: {c}")
    return df


# ---------------------------------------------------------------- V2
def type_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, cells, numeric_cells, is_numeric) per measure column: how many filled
    cells of the table there are and how many hold a finite number. Counted over
    all rows in one aggregation, so raw text columns are judged by what they hold."""
    cols = [c for c in (columns if columns is not None else NUMERIC_COLUMNS) if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, cells long, numeric_cells long, is_numeric boolean")
    counts = df.agg(*[x for c in cols for x in (
        F.count(F.col(c)).alias(f"{c}#cells"), F.count(coerce_number(F.col(c), df.schema[c].dataType)).alias(f"{c}#numeric"))])
    stack = ", ".join(f"'{c}', `{c}#cells`, `{c}#numeric`" for c in cols)
    return counts.selectExpr(f"stack({len(cols)}, {stack}) AS (column, cells, numeric_cells)").withColumn(
        "is_numeric", F.col("cells") == F.col("numeric_cells"))


# ---------------------------------------------------------------- V3-V5
def range_rules() -> list[tuple]:
    """(rule, column, condition) triples; built lazily (Columns need a session)."""
    return [
        ("negative_price", "price", F.col("price") < 0),
        ("negative_units_sold", "units_sold", F.col("units_sold") < 0),
        ("discount_above_100", "discount", F.col("discount") > 100),
    ]


def range_checks(df: DataFrame) -> DataFrame:
    """(rule, column, violations, passed) — all rules counted in one pass."""
    rules = [(n, c, cond) for n, c, cond in range_rules() if c in df.columns]
    counts = df.agg(*[F.count_if(cond).alias(n) for n, _, cond in rules])
    stack = ", ".join(f"'{n}', '{c}', `{n}`" for n, c, _ in rules)
    return (counts.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, column, violations)")
            .withColumn("passed", F.col("violations") == 0))


# ---------------------------------------------------------------- V8 / V9 / V10
def null_checks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: ``null_<column>`` = number of NULL cells, one aggregation."""
    cols = columns if columns is not None else df.columns
    return df.agg(*[F.sum(F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0)).cast("bigint").alias(f"null_{c}")
                    for c in cols])


def table_shape(df: DataFrame) -> DataFrame:
    """(row_count, column_count); the column count is schema metadata."""
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.lit(len(df.columns)).alias("column_count"))


# ---------------------------------------------------------------- V6
def validation_report(df: DataFrame) -> DataFrame:
    """(check, target, violations, passed) of a raw table: missing required columns
    (1 each), cells of measure columns that are no number, and range violations of
    the coerced numbers. Type and range findings only warn; one pass over the rows."""
    absent = missing_columns(df)
    columns = df.sparkSession.createDataFrame([("required_columns", c, int(c in absent)) for c in REQUIRED_COLUMNS],
                                              "check string, target string, violations long")
    present = [c for c in NUMERIC_COLUMNS if c in df.columns]
    if not present:
        return columns.withColumn("passed", F.col("violations") == 0)
    # Cells and numbers side by side, so that one aggregation counts both kinds of findings.
    rows = df.select(*[F.col(c).alias(f"{c}#cell") for c in present], *[coerce_number(F.col(c), df.schema[c].dataType).alias(c) for c in present])
    rules = [r for r in range_rules() if r[1] in present]
    counts = rows.agg(*[(F.count(F.col(f"`{c}#cell`")) - F.count(c)).alias(f"{c}#bad") for c in present], *[F.count_if(broken).alias(name) for name, _, broken in rules])
    found = [f"'numeric_type', '{c}', `{c}#bad`" for c in present] + [f"'{name}', '{c}', `{name}`" for name, c, _ in rules]
    return columns.unionByName(counts.selectExpr(f"stack({len(found)}, {', '.join(found)}) AS (check, target, violations)")).withColumn("passed", F.col("violations") == 0)


# ---------------------------------------------------------------- V11
STAGE_NAMES = ["raw", "deduplicated", "valid_date", "valid_target", "within_fence"]


def stage_table(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """(ord, stage, rows) from the counts that the pipeline observed."""
    return spark.createDataFrame([(i + 1, name, int(counts[name])) for i, name in enumerate(STAGE_NAMES)], "ord int, stage string, rows long")
