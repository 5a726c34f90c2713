"""Exact quantiles without gathering or ordering the rows.

A sketch first brackets each wanted rank. While a bracket of some group may
hold more than ``GATHERED`` rows, a round narrows it: the rows in it are sketched at
a thousand ranks, counted below it, and the two sketched values around the wanted
rank are the next bracket. One last aggregation counts the rows outside the
brackets, a number per gap, and keeps the distinct values inside with their
counts. Only these few are ordered, as one array per group, and a running sum over
it finds the exact ranks, so ties are found wherever they lie. No window is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import counted_broadcast, one_row

#: Relative rank error of the first sketch, as one part in so many rows.
ACCURACY = 50_000
#: Rows of a group that may lie in a bracket without another round.
GATHERED = 1 << 20
#: Ranks that a round sketches inside a bracket, and the sketch's accuracy.
STEPS, STEP_ACCURACY = 1000, 100_000


def written(df: DataFrame) -> DataFrame:
    """A small table (a row per group), computed now and kept in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _with(rows: DataFrame, bounds: DataFrame, keys: list[str], groups: int) -> DataFrame:
    if not keys:
        return rows.crossJoin(one_row(bounds))
    names = [f"_key{i}" for i in range(len(keys))]
    right = bounds.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in bounds.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return rows.join(counted_broadcast(right, groups), same).drop(*names)


def _inside(i: int) -> Column:
    return F.col("_v").between(F.col("_b")[2 * i], F.col("_b")[2 * i + 1])


def _narrowed(rows: DataFrame, bounds: DataFrame, keys: list[str], probs: list[float], groups: int) -> DataFrame:
    """``bounds`` with brackets inside the old ones: ``_b``, and ``_m``, the rows in the fullest."""
    ranks = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    parts = []
    for i in range(len(probs)):
        own = F.when(_inside(i), F.col("_v"))
        parts += [F.count_if(F.col("_v") < F.col("_b")[2 * i]).alias(f"_below{i}"), F.count(own).alias(f"_m{i}"),
                  F.percentile_approx(own, ranks, STEP_ACCURACY).alias(f"_s{i}")]
    found = _with(rows, bounds.select(*keys, "_b", "_n"), keys, groups).groupBy(*keys, "_n").agg(*parts)
    edges, held = [], []
    for i, p in enumerate(probs):
        # Both neighbours of the wanted place lie within two steps and two rows of it.
        rows_in = F.greatest(F.col(f"_m{i}") - 1, F.lit(1))
        place = (F.lit(float(p)) * (F.col("_n") - 1) - F.col(f"_below{i}")) / rows_in * STEPS
        margin = F.lit(2.0) + F.lit(2.0 * STEPS) / rows_in
        low = F.greatest(F.floor(place - margin), F.lit(0)).cast("int")
        high = F.least(F.ceil(place + margin), F.lit(STEPS)).cast("int")
        edges += [F.col(f"_s{i}")[low], F.col(f"_s{i}")[high]]
        held.append(F.col(f"_m{i}"))
    return found.select(*keys, "_n", F.array(*edges).alias("_b"), (F.greatest(*held, F.lit(0)) * 6 / STEPS).cast("long").alias("_m"))


def exact_quantiles(df: DataFrame, column: str | Column, probs: list[float], by: list[str] | None = None,
                    accuracy: int = ACCURACY, gathered: int = GATHERED) -> DataFrame:
    """One row (per group): ``n`` (rows with a value) and ``q0``, ``q1``, ..., linearly interpolated.

    The brackets, a row per group, are found by jobs that run now; the last
    aggregation is lazy. Rows without a value are ignored, and groups without any
    give no row, nor does an empty table.
    """
    keys = by or []
    value = F.col(column) if isinstance(column, str) else column
    rows = df.select(*keys, value.cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull())
    margin = 2 / accuracy
    ranks = [F.lit(float(x)) for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))]
    bounds = rows.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*ranks), accuracy).alias("_b"), F.count("_v").alias("_n"))
    # Small groups are gathered whole; the sketch's error is at most one accuracy-th to each side.
    bounds = bounds.withColumn("_m", F.when(F.col("_n") <= 10 * accuracy, 0).otherwise(F.col("_n") * 6 / accuracy).cast("long"))
    bounds = written(bounds)
    fullest, groups = bounds.agg(F.max("_m"), F.count(F.lit(1))).first()
    while fullest is not None and fullest > gathered:
        before, bounds = fullest, written(_narrowed(rows, bounds, keys, probs, groups))
        fullest = bounds.agg(F.max("_m")).first()[0]
        if fullest >= before:  # nothing but ties is left between the borders
            break
    rows = _with(rows, bounds.drop("_m"), keys, groups)
    inside = reduce(lambda a, b: a | b, [_inside(i) for i in range(len(probs))]) | (F.col("_n") <= 10 * accuracy)
    gap = sum((F.col("_v") > F.col("_b")[2 * i + 1]).cast("int") for i in range(len(probs)))
    held = rows.groupBy(*keys, "_n", F.when(inside, F.col("_v")).alias("_value"), F.when(~inside, gap).alias("_gap")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_from"))
    entry = F.struct(F.col("_from").alias("v"), F.col("_rows").alias("n"))
    ordered = held.groupBy(*keys, "_n").agg(F.sort_array(F.collect_list(entry)).alias("_held"))
    none = F.lit(None).cast("double")

    def at(rank: Column) -> Column:
        """The value at this place (from 0): the entry that the running count passes it with."""
        start = F.struct(F.lit(0).cast("long").alias("seen"), none.alias("v"))
        found = F.aggregate("_held", start, lambda s, x: F.struct(
            (s["seen"] + x["n"]).alias("seen"), F.when((rank >= s["seen"]) & (rank < s["seen"] + x["n"]), x["v"]).otherwise(s["v"]).alias("v")))
        return found["v"]

    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    parts = [x.alias(f"_{name}{i}") for i, p in enumerate(place) for name, x in (("low", at(F.floor(p))), ("high", at(F.ceil(p))))]
    found = ordered.select(*keys, "_n", *parts)
    share = [p - F.floor(p) for p in place]
    out = [((1 - s) * F.col(f"_low{i}") + s * F.col(f"_high{i}")).alias(f"q{i}") for i, s in enumerate(share)]
    return found.select(*keys, F.col("_n").alias("n"), *out)
