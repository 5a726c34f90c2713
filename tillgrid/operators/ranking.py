"""Sorting, top-k and rankings over keyed aggregates.

Inputs are keyed sums (one row per key), so their size is the key domain
(months, categories, regions), not the row count. Top-k uses
``orderBy().limit()`` which plans as a distributed TakeOrderedAndProject.
All orders are total: value, then key ascending, so ties are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TOP_K


def sort_by_key(keyed: DataFrame, key: str) -> DataFrame:
    """Ascending key order (e.g. month)."""
    return keyed.orderBy(F.col(key).asc())


def top_k(keyed: DataFrame, key: str, k: int = TOP_K, value: str = "total_units") -> DataFrame:
    """The k largest values, (rank, key, value); ties -> smaller key first."""
    top = keyed.orderBy(F.col(value).desc(), F.col(key).asc()).limit(k)
    w = Window.orderBy(F.col(value).desc(), F.col(key).asc())
    return top.select(F.row_number().over(w).alias("rank"), key, value)


def bottom_k(keyed: DataFrame, key: str, k: int = TOP_K, value: str = "total_units") -> DataFrame:
    """T4: the last k entries of the descending list, shown descending.

    With fewer than 2k keys the list overlaps the top-k, as in the original.
    """
    tail = keyed.orderBy(F.col(value).asc(), F.col(key).desc()).limit(k)
    w = Window.orderBy(F.col(value).desc(), F.col(key).asc())
    return tail.select(F.row_number().over(w).alias("rank"), key, value)


def ranking(keyed: DataFrame, key: str, value: str = "total_units") -> DataFrame:
    """Dense listing 1..n by value descending, key ascending on ties."""
    w = Window.orderBy(F.col(value).desc(), F.col(key).asc())
    return keyed.select(F.row_number().over(w).alias("rank"), key, value)


def best_worst(keyed: DataFrame, key: str, value: str = "total_units") -> DataFrame:
    """(best, worst) keys in one aggregation (arg-max / arg-min)."""
    return keyed.agg(
        F.min_by(F.col(key), F.struct(-F.col(value), F.col(key))).alias(f"best_{key}"),
        F.min_by(F.col(key), F.struct(F.col(value), F.col(key))).alias(f"worst_{key}"),
    )
