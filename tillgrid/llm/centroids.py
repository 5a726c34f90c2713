"""Centroid clustering (Lloyd rounds) with an equal-average equal-variance nearest-centroid search.

Vectors become integers, floor(64 x). Centroids are sorted by the sum of their
components (their mean). A vector's search starts where its own sum falls in
that order and goes outward, each time to the nearer side. With n components,
a squared distance is at least (difference of sums)**2 / n, so the search ends
when even the nearer side's bound is beyond the best distance so far; adding
the squared difference of the deviations from the mean rejects further
centroids without a look at their components. What is left is computed in whole numbers.
Bounds reject only what is strictly farther (sums as integers, deviations with
a margin for rounding), so equal distances go to the smaller number. The scan
advances for all vectors of an Arrow batch together.

Each round is one pass: tasks hand over one row of exact sums and counts for
each centroid, and these meet by centroid and component. What reaches the driver
are the ``k`` centroids, a parameter; the first are the kept rows with
the smallest SHA-256 of ``1:<vec_id>`` (rows without vec_id last, ties by the vector).

Rows whose vector is null, of another length, or holds null or non-finite
components take no part. Components are bounded to +-2**62 after scaling;
vectors too large for 64-bit distances are searched whole in unbounded integers,
and a distance or inertia beyond 64 bits is null. Fewer vectors than ``k`` give
as many centroids as vectors. Repeated rows count as often as they occur; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.testdata import table
from .common import cut, map_arrow

SCALE, DIMENSIONS, K, ROUNDS = 64, 64, 16, 3
LARGEST = 2**62
_WIDE = decimal.Context(prec=60)


def whole_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x`` (whole components) of the rows that take part; written once."""
    good = (F.size("embedding") == dimensions) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = F.lit(float(LARGEST))
    x = F.transform("embedding", lambda v: F.floor(F.greatest(-bound, F.least(bound, v.cast("double") * F.lit(float(scale))))).cast("long"))
    return cut(rows.where(F.col("embedding").isNotNull() & good).select("vec_id", x.alias("x")), "whole-vectors")


def first_centroids(vectors: DataFrame, k: int = K) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [list(r["x"]) for r in vectors.select(key.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]


class Search:
    """Centroids sorted by their sums, with their deviations from the mean."""

    def __init__(self, centroids: list[list[int]]):
        self.all = centroids
        self.n = len(centroids[0])
        self.large = max(abs(v) for c in centroids for v in c)
        if self.fits(self.large):
            c = np.array(centroids, np.int64)
            self.number = np.lexsort((np.arange(len(c)), c.sum(1)))
            self.c = c[self.number]
            self.sums, self.deviations = self._marks(self.c)

    def fits(self, largest: int) -> bool:
        """Whether every term of the search stays within 64 bits."""
        return 2 * self.n * largest < 2**31

    def _marks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums, and n times the deviation's length (the root of n |x|**2 - sum**2, times the root of n)."""
        sums = x.sum(1)
        return sums, np.sqrt((self.n * (x * x).sum(1) - sums * sums).astype(float))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray, int]:
        """Each row's centroid, its squared distance, and how many distances were computed."""
        if not self.fits(max(self.large, int(np.abs(x).max(initial=0)))):
            own, away = np.zeros(len(x), np.int64), []
            for i, row in enumerate(x.tolist()):
                d, own[i] = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(self.all))
                away.append(d)
            return own, away, len(x) * len(self.all)
        k, n = len(self.c), self.n
        sums, deviations = self._marks(x)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best, own = np.full(len(x), 2**61, np.int64), np.full(len(x), k, np.int64)
        active, computed = np.arange(len(x)), 0
        while len(active):
            lo, hi, s = left[active], right[active], sums[active]
            below = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], 2**31)
            above = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - s, 2**31)
            go_left = below <= above
            gap, at = np.where(go_left, below, above), np.where(go_left, lo, hi)
            # Sums are sorted, so nothing farther out on either side is nearer.
            on = (gap < 2**31) & (gap * gap <= n * np.minimum(best[active], 2**61 // n))
            active, at, gap, go_left = active[on], at[on], gap[on], go_left[on]
            left[active] -= go_left
            right[active] += ~go_left
            a, b = deviations[active], self.deviations[at]
            apart = np.maximum(0.0, np.abs(a - b) - 1e-12 * (a + b))
            bound = (gap.astype(float) ** 2 + apart * apart) / n * (1 - 1e-12)
            near = bound <= best[active]
            rows, at = active[near], at[near]
            diff = x[rows] - self.c[at]
            d, j = (diff * diff).sum(1), self.number[at]
            computed += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (j < own[rows]))
            best[rows[better]], own[rows[better]] = d[better], j[better]
        return own, best, computed


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the componentwise means; a centroid without vectors stays."""
    n = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = Search(centroids), [[0] * n for _ in centroids], [0] * len(centroids)
        for batch in batches:
            x = _matrix(batch.column("x"), n)
            wide = len(x) * int(np.abs(x).max(initial=0)) >= 2**62
            own, _, _ = search.nearest(x)
            for j in np.unique(own).tolist():
                held = x[own == j]
                more = [sum(c) for c in held.T.tolist()] if wide else held.sum(0).tolist()
                sums[j] = [a + b for a, b in zip(sums[j], more, strict=True)]
                counts[j] += len(held)
        used = [j for j, c in enumerate(counts) if c]
        total = pa.array([[_WIDE.create_decimal(v) for v in sums[j]] for j in used], pa.list_(pa.decimal128(38, 0)))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([counts[j] for j in used], pa.int64()), total], ["cluster", "n", "total"])

    parts = map_arrow(vectors.select("x"), run, "cluster int, n long, total array<decimal(38,0)>")
    summed = parts.select("cluster", "n", F.posexplode("total").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    out = [list(c) for c in centroids]
    for r in summed.collect():  # k x n rows
        out[r["cluster"]][r["i"]] = int(r["v"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``; written once."""
    n = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            own, away, _ = search.nearest(_matrix(batch.column("x"), n))
            away = pa.array(away, pa.int64()) if isinstance(away, np.ndarray) else pa.array([d if d < 2**63 else None for d in away], pa.int64())
            yield pa.record_batch([batch.column("vec_id"), pa.array(own, pa.int32()), away], ["vec_id", "cluster", "distance"])

    return cut(map_arrow(vectors, run, f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long"), "assigned-vectors")


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id``, ``cluster``, ``distance`` per vector that takes part, and the final centroids."""
    vectors = whole_vectors(rows, dimensions, scale)
    centroids = first_centroids(vectors, k)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    return assigned(vectors, centroids), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, centroids = cluster(table(spark, sf_dir, "embeddings"))
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in own.groupBy("cluster").agg(whole.alias("s")).collect()}  # k rows
    total = None if None in sums.values() else sum(sums.values())
    fit = lambda v: None if v is None or v >= 2**63 else int(v)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = spark.createDataFrame([(j, fit(s), fit(total), hashes[j]) for j, s in sorted(sums.items())],
                               "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return own.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    """Assignment to the centroids ``c{i}``, and the centroids after it."""
    return f"""
p{i} AS (SELECT v.r, c.k, CAST(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) AS d FROM v, c{i} c),
a{i} AS (SELECT r, k, d FROM p{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1),
m{i} AS (SELECT a.k, e.i, CAST(sum(e.c) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN e ON a.r = e.r GROUP BY a.k, e.i),
n{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM m{i} GROUP BY k),
c{i + 1} AS (SELECT c.k, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN n{i} n ON c.k = n.k),"""


#: Doubles hold these whole numbers exactly.
OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIMENSIONS}
    AND len([1 FOR c IN embedding IF c IS NULL OR isnan(c) OR isinf(c)]) = 0),
e AS (SELECT r, generate_subscripts(x, 1) AS i, CAST(unnest(x) AS BIGINT) AS c FROM v),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS k, x FROM v QUALIFY k < {K}),
{''.join(_round_sql(i) for i in range(ROUNDS))}
p AS (SELECT v.r, c.k, CAST(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) AS d FROM v, c{ROUNDS} c),
a AS (SELECT r, k, d FROM p QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1),
h AS (SELECT k, sha256(array_to_string([CAST(CAST(c AS BIGINT) AS VARCHAR) FOR c IN x], ',')) AS centroid_sha256 FROM c{ROUNDS})
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a JOIN v ON a.r = v.r JOIN h ON a.k = h.k
"""
