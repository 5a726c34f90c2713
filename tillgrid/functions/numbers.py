"""Numeric coercion and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

# Plain decimal or scientific literal with optional sign and surrounding blanks.
# Thousands separators, words ("True", "inf", "NaN") and suffixes ("1d") fail.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def literal_number(text: Column) -> Column:
    """DOUBLE of a number's literal (infinite if it is too large); any other text -> NULL."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def coerce_number(col: Column, source_type: DataType | None = None) -> Column:
    """Value -> DOUBLE; anything that is not a finite number becomes NULL.

    Text is guarded by a literal pattern before ``try_cast`` so forms Spark
    would accept but the contract rejects ("NaN", "1d", "Infinity") never slip
    through. Numeric input is only widened; NaN/inf are mapped to NULL so they
    cannot poison sums or sort as largest.
    """
    if source_type is not None and isinstance(source_type, NumericType):
        return finite(col.cast("double"))
    return finite(literal_number(col.cast("string")))
