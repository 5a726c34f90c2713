"""Centroid clustering against brute force in unbounded integers and against its SQL."""

import hashlib
import math
import random

import numpy as np
import pytest
from oracle_harness import SF_SMALL, compare

from tillgrid.llm import centroids
from tillgrid.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, x string, cluster string, distance string"


def rows_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "c", "d") for i, v in rows], SCHEMA)


def brute(rows, k=16, rounds=3, n=64):
    kept = [(i, [math.floor(max(-(2.0**62), min(2.0**62, 64.0 * c))) for c in v]) for i, v in rows
            if v is not None and len(v) == n and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            held = [v for (_, v), o in zip(kept, own) if o == j]
            if held:
                c[j] = [sum(x) // len(held) for x in zip(*held)]
    found = [(i, *near(v)) for i, v in kept]
    per = {j: sum(d for _, d, o in found if o == j) for j in range(len(c))}
    fit = lambda d: None if d >= 2**63 else d
    large = {j for _, d, j in found if d >= 2**63}
    return sorted(((str(i), j, str(fit(d)), str(None if j in large else fit(per[j])), str(None if large else fit(sum(per.values()))),
                    hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found))


def found(df):
    return sorted((str(r["vec_id"]), r["cluster"], str(r["distance"]), str(r["cluster_inertia"]), str(r["inertia"]), r["centroid_sha256"]) for r in df.collect())


def vectors(seed, n, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for i in range(n)]


def odd():
    v = vectors(4, 2)[0][1]
    return [(500, None), (501, []), (502, v[:63]), (503, [*v, 0.0]), (504, [None, *v[1:]]), (505, [float("nan"), *v[1:]]), (506, [float("-inf"), *v[1:]]),
            (None, v), (None, [1.0] * 64), (507, [0.0] * 64), (507, [0.0] * 64), (508, [-1 / 128] * 64), (509, [1 / 128] * 64), (510, v), (510, v)]


@pytest.mark.parametrize("rows", [vectors(1, 300) + odd(), odd(), [(i, [1.0] * 64) for i in range(40)], vectors(2, 5), vectors(3, 200, 0.01)])
def test_matches_brute_force(spark, table, rows):
    sf = table(embeddings=rows_frame(spark, rows).repartition(4))
    assert found(QUERIES["op12_centroids"](spark, sf)) == brute(rows)


def test_large_components(spark, table):
    rows = vectors(6, 40) + [(900, [1e300] * 64), (901, [-1e300] + [1.0] * 63), (902, [2.0**40] * 64), (903, [2.0**26, *[0.5] * 63])]
    sf = table(embeddings=rows_frame(spark, rows))
    assert found(QUERIES["op12_centroids"](spark, sf)) == brute(rows)


def test_empty(spark, table):
    for rows in ([], [(1, None), (2, [1.0])]):
        sf = table(embeddings=rows_frame(spark, rows))
        df = QUERIES["op12_centroids"](spark, sf)
        assert df.collect() == [] and df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_sql(spark):
    assert compare(spark, "op12_centroids", QUERIES["op12_centroids"], ORACLE["op12_centroids"], SF_SMALL)["status"] == "exact"


def test_search_rejects_without_losing(spark):
    rng = np.random.default_rng(3)
    for spread in (3, 40, 900):
        c = rng.integers(-spread, spread + 1, (64, 16)) + rng.integers(-400, 400, (64, 1))
        x = c[rng.integers(0, 64, 500)] + rng.integers(-spread, spread + 1, (500, 16))
        own, away, computed = centroids.Search(c.tolist()).nearest(x)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all() and (np.asarray(away) == d.min(1)).all()
        assert computed < d.size * {3: 0.1, 40: 0.5, 900: 1.0}[spread]
