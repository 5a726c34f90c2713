"""Exact top-k by inner product: best-first search in M-trees.

Vectors become integers, floor(1024 x). With one more coordinate that lifts
all of them to the same length (the largest), a larger inner product with a
query is a smaller Euclidean distance, so a metric tree can serve.

Vectors are dealt into shards of bounded size by a hash of their row, and
each shard's M-tree is built once and written: pages of entries, where a
routing entry holds its object, its covering radius, its distance to the
parent and its page, and a leaf entry its object and its distance to the
parent. Queries come in blocks of bounded size, packed once like the trees; a tree is
dealt once for several blocks, and meets them one after the other. Neither side of that
is broadcast: both are many times what they were made from. A search takes the page with the least possible distance
first, and skips an entry when the stored distance to the parent already
proves, by the triangle inequality, that it lies beyond the k-th best so far;
only the others cost a distance. The queries of a block search together: a page is taken
once for all that still need it, each with its own bounds, after every query has seen the leaf next to it. Bounds are compared with a margin for
rounding; scores are whole numbers, and equal ones go to the smaller vec_id. Products are
taken in doubles where tree and query are small enough for these to be exact, else in 64-bit or
unbounded integers.

Vectors that are null or hold null or non-finite components take no part, nor
do rows without vec_id; shorter vectors count as ending in zeros. Equal
vectors are points at distance zero; each is a result of its own. A repeated
vec_id is a row like any other, so it finds its twin, and a repeated query is
answered once per row. Components are bounded to +-2**58 after scaling; scores beyond 64 bits are
ranked exactly and given as null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import decimal
import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.testdata import table
from .common import cut, map_arrow, ship_package

K, SCALE = 10, 1024
#: Entries in a page, vectors in a shard's tree, queries in a block.
PAGE, SHARD, BLOCK = 64, 4096, 512
#: Blocks that a tree meets in one task at most, and cells of trees and blocks from which on it meets several.
TOGETHER, CELLS = 16, 256
#: Tasks over which the cells are dealt at most.
MOST_TASKS = 1 << 14
#: Columns of what a cell gives.
FOUND = ["row", "query_id", "vec_id", "score"]
#: Components beyond this are taken as this.
LARGEST = 2**58


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``row`` (a number per row), ``vec_id``, ``x`` (whole components) and ``n2`` (squared length, a double); written once."""
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = F.lit(float(LARGEST))
    x = F.transform("embedding", lambda v: F.floor(F.greatest(-bound, F.least(bound, v.cast("double") * F.lit(float(scale))))).cast("long"))
    held = rows.where(good).select(F.monotonically_increasing_id().alias("row"), "vec_id", x.alias("x"))
    return cut(held.withColumn("n2", F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))), "whole-vectors")


class MTree:
    """A shard's tree in flat arrays; entry 0 is the root's page."""

    FIELDS = ("row", "ids", "x", "up", "e_at", "e_radius", "e_up", "e_first", "e_last", "e_leaf")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.x = self.x.astype(np.int64)
        self.largest, self.copies = int(np.abs(self.x).max(initial=0)), {np.int64: self.x}

    def exact_kind(self, largest: int) -> np.ndarray:
        """The vectors, of the kind of number whose products with queries of components up to ``largest`` are exact."""
        most = self.largest * largest * max(1, self.x.shape[1])
        kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
        if kind not in self.copies:
            self.copies[kind] = self.x.astype(kind)
        return self.copies[kind]

    def exact_for(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors and the query, of such a kind."""
        x = self.exact_kind(max(map(abs, query.tolist()), default=0))
        q = np.zeros(self.x.shape[1], x.dtype)
        q[: len(query)] = query.tolist()[: len(q)] if x.dtype == object else query[: len(q)]
        return x, q

    @classmethod
    def build(cls, row: np.ndarray, ids: np.ndarray, x: np.ndarray, longest: float, page: int = PAGE, seed: int = 0) -> MTree:
        rng = np.random.default_rng(seed)
        lifted = np.concatenate([x.astype(float), np.sqrt(np.maximum(0.0, float(longest) - (x.astype(float) ** 2).sum(1)))[:, None]], axis=1)
        order: list[np.ndarray] = []
        up: list[np.ndarray] = []
        entries: list[list] = [[0, np.inf, 0.0, 0, 0, False]]  # object, radius, distance to parent, first, last, leaf
        placed, queue = 0, [(0, np.arange(len(x)))]
        while queue:
            entry, own = queue.pop(0)
            away = np.sqrt(((lifted[own] - lifted[entries[entry][0]]) ** 2).sum(1))
            if len(own) <= page:
                entries[entry][3:] = [placed, placed + len(own), True]
                order.append(own)
                up.append(away)
                placed += len(own)
                continue
            n = min(page, -(-len(own) // (page // 2)))
            chosen = own[rng.choice(len(own), n, replace=False)]
            near = ((lifted[own][:, None] - lifted[chosen][None]) ** 2).sum(2).argmin(1) if len(own) <= 1 << 14 else \
                np.concatenate([((lifted[part][:, None] - lifted[chosen][None]) ** 2).sum(2).argmin(1) for part in np.array_split(own, -(-len(own) // 4096))])
            groups = [own[near == k] for k in range(n)]
            if max(map(len, groups)) == len(own):  # equal points can't be told apart by distance
                groups = np.array_split(own, n)
                chosen = np.array([g[0] for g in groups])
            first = len(entries)
            for at, group in zip(chosen, groups, strict=True):
                if len(group):
                    radius = np.sqrt(((lifted[group] - lifted[at]) ** 2).sum(1).max())
                    entries.append([at, radius, float(np.sqrt(((lifted[at] - lifted[entries[entry][0]]) ** 2).sum())), 0, 0, False])
                    queue.append((len(entries) - 1, group))
            entries[entry][3:] = [first, len(entries), False]
        order_, place = np.concatenate(order), np.empty(len(x), np.int64)
        place[order_] = np.arange(len(x))
        columns = [np.array(c) for c in zip(*entries, strict=True)]
        columns[0] = place[columns[0]]
        return cls(row=row[order_], ids=ids[order_], x=x[order_], up=np.concatenate(up), **dict(zip(cls.FIELDS[4:], columns, strict=True)))

    def dump(self) -> bytes:
        return _dumped(**{name: getattr(self, name) for name in self.FIELDS})

    @classmethod
    def load(cls, raw: bytes) -> MTree:
        with np.load(io.BytesIO(raw), allow_pickle=False) as held:
            return cls(**{name: held[name] for name in cls.FIELDS})

    def search(self, query: np.ndarray, own: int, longest: float, k: int = K) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best (score, vec_id), best first, and how many distances were computed."""
        x, q = self.exact_for(query)
        base = float((query.astype(float) ** 2).sum()) + float(longest)
        margin = 1e-6 * max(1.0, np.sqrt(base))
        best: list[tuple[int, int]] = []  # a heap: the worst first, ties by the larger id
        reach, computed = np.inf, 1
        root = np.sqrt(max(0.0, base - 2 * float(x[self.e_at[0]] @ q)))
        pages = [(0.0, 0, root)]
        while pages:
            least, entry, to_parent = heapq.heappop(pages)
            if least > reach + margin:
                break
            first, last = self.e_first[entry], self.e_last[entry]
            if not self.e_leaf[entry]:
                near = first + np.flatnonzero(np.abs(to_parent - self.e_up[first:last]) - self.e_radius[first:last] <= reach + margin)
                away = np.sqrt(np.maximum(0.0, base - 2 * (x[self.e_at[near]] @ q).astype(float)))
                computed += len(near)
                for e, d, r in zip(near.tolist(), away.tolist(), self.e_radius[near].tolist(), strict=True):
                    if d - r <= reach + margin:
                        heapq.heappush(pages, (max(0.0, d - r), e, d))
                continue
            near = first + np.flatnonzero((np.abs(to_parent - self.up[first:last]) <= reach + margin) & (self.row[first:last] != own))
            if not len(near):
                continue
            score = x[near] @ q
            score = score if x.dtype == object else score.astype(np.int64)
            computed += len(near)
            if len(best) == k:
                good = score >= best[0][0]
                near, score = near[good], score[good]
            for s, i in zip(score.tolist(), self.ids[near].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                reach = np.sqrt(max(0.0, base - 2 * float(best[0][0])))
        return [(s, -i) for s, i in sorted(best, reverse=True)], computed


    def search_block(self, queries: np.ndarray, own: np.ndarray, longest: float, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best of every query: its place in the block, ``vec_id`` and score (whole numbers of any size), as `search` finds them."""
        m, x = len(queries), self.exact_kind(int(np.abs(queries).max(initial=0)))
        if x.dtype == object:
            found = [(i, v, s) for i in range(m) for s, v in self.search(queries[i], int(own[i]), longest, k)[0]]
            places, ids, scores = zip(*found, strict=True) if found else ((), (), ())
            return np.array(places, np.int64), np.array(ids, np.int64), np.array(scores, object)
        width = self.x.shape[1]
        q = np.zeros((m, width), x.dtype)
        q[:, : queries.shape[1]] = queries[:, :width]
        base = (queries.astype(float) ** 2).sum(1) + float(longest)
        margin = 1e-6 * np.maximum(1.0, np.sqrt(base))
        none = -(2**62)  # below every score
        score, ids, reach = np.full((m, k), none, np.int64), np.zeros((m, k), np.int64), np.full(m, np.inf)
        seen: dict[int, np.ndarray] = {}

        def away(of: np.ndarray, points: np.ndarray | slice) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, base[of, None] - 2 * (q[of] @ x[points].T).astype(float)))

        def leaf(entry: int, of: np.ndarray, to_parent: np.ndarray) -> None:
            first, last = self.e_first[entry], self.e_last[entry]
            can = np.abs(to_parent[:, None] - self.up[None, first:last]) <= (reach[of] + margin[of])[:, None]
            points = first + np.flatnonzero(can.any(0))
            got = (q[of] @ x[points].T).astype(np.int64)
            got[self.row[points][None] == own[of, None]] = none
            some = (got > none) & (got >= score[of, -1][:, None])
            better = np.flatnonzero(some.any(1))
            if len(better):
                at = of[better]
                scores = np.concatenate([score[at], np.where(some[better], got[better], none)], axis=1)
                names = np.concatenate([ids[at], np.broadcast_to(self.ids[points], (len(at), len(points)))], axis=1)
                order = np.lexsort((names, -scores), axis=-1)[:, :k]
                score[at], ids[at] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
                full = score[at, -1] > none
                reach[at[full]] = np.sqrt(np.maximum(0.0, base[at[full]] - 2 * score[at[full], -1].astype(float)))

        every = np.arange(m)
        root = away(every, self.e_at[:1])[:, 0]
        # First, each query sees the leaf next to it, so that its bounds are narrow early.
        down = [(0, every, root)]
        while down:
            entry, of, to_parent = down.pop()
            if self.e_leaf[entry]:
                leaf(entry, of, to_parent)
                seen[entry] = of
                continue
            first, last = self.e_first[entry], self.e_last[entry]
            d = away(of, self.e_at[first:last])
            nearest = d.argmin(1)
            down += [(first + c, of[nearest == c], d[nearest == c, c]) for c in np.unique(nearest).tolist()]
        pages = [(0.0, 0, np.zeros(m), every, root)]
        while pages:
            _, entry, least, of, to_parent = heapq.heappop(pages)
            open_ = least <= reach[of] + margin[of]
            if entry in seen:
                open_ &= ~np.isin(of, seen[entry])
            of, to_parent = of[open_], to_parent[open_]
            if not len(of):
                continue
            if self.e_leaf[entry]:
                leaf(entry, of, to_parent)
                continue
            first, last = self.e_first[entry], self.e_last[entry]
            bound, radius = (reach[of] + margin[of])[:, None], self.e_radius[first:last][None]
            can = np.abs(to_parent[:, None] - self.e_up[None, first:last]) - radius <= bound
            near = np.flatnonzero(can.any(0))
            d = away(of, self.e_at[first + near])
            least = np.maximum(0.0, d - radius[:, near])
            for j, c in enumerate(near.tolist()):
                go = np.flatnonzero(can[:, c] & (least[:, j] <= bound[:, 0]))
                if len(go):
                    heapq.heappush(pages, (float(least[go, j].min()), int(first + c), least[go, j], of[go], d[go, j]))
        place, rank = np.nonzero(score > none)
        return place, ids[place, rank], score[place, rank]


def _dumped(x: np.ndarray, **arrays: np.ndarray) -> bytes:
    """Arrays as bytes, ``x`` with whole numbers as narrow as they may be."""
    out, largest = io.BytesIO(), float(np.abs(x).max(initial=0))
    np.savez(out, **arrays, x=x.astype(np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.int64))
    return out.getvalue()


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _shards(vectors: DataFrame, shard: int) -> int:
    return max(1, -(-vectors.count() // shard))


def build_trees(vectors: DataFrame, longest: float, shard: int = SHARD) -> DataFrame:
    """``shard``, ``tree``: the written M-trees, one row each."""
    n = _shards(vectors, shard)
    ship_package(vectors.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("row")
        tree = MTree.build(group["row"].to_numpy(), group["vec_id"].to_numpy(), _matrix(group["x"]), longest)
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int64()), "tree": pa.array([tree.dump()], pa.binary())})

    dealt = vectors.select("row", F.col("vec_id").cast("long").alias("vec_id"), "x", F.pmod(F.xxhash64("row"), F.lit(n)).alias("shard"))
    return cut(dealt.groupBy("shard").applyInArrow(run, "shard long, tree binary"), "metric-trees")


def pack_queries(queries: DataFrame, blocks: int) -> DataFrame:
    """``block``, ``queries``: the queries dealt into this many blocks, one written row each."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("row")
        held = _dumped(_matrix(group["x"]), row=group["row"].to_numpy(), ids=group["vec_id"].to_numpy())
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int64()), "queries": pa.array([held], pa.binary())})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)))
    return cut(dealt.groupBy("block").applyInArrow(run, "block long, queries binary"), "query-blocks")


def top_k(rows: DataFrame, is_query: Column, k: int = K, shard: int = SHARD, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows of ``rows`` where ``is_query`` holds."""
    vectors = whole_vectors(rows, scale)
    longest = vectors.agg(F.coalesce(F.max("n2"), F.lit(0.0))).first()[0]
    trees = build_trees(vectors, longest, shard)
    queries = vectors.where(is_query).select("row", F.col("vec_id").cast("long").alias("vec_id"), "x")
    blocks, shards = max(1, -(-queries.count() // block)), _shards(vectors, shard)
    packed = pack_queries(queries, blocks)
    # A cell is a tree with some of the blocks; both sides are dealt by it, each with no more copies than it has cells.
    together = max(1, min(TOGETHER, blocks * shards // CELLS))
    groups = -(-blocks // together)
    tasks = max(1, min(2 * shards * groups, MOST_TASKS))
    numbers = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (groups, shards)]
    left = trees.withColumn("cell", numbers[0]).repartition(tasks, "shard", "cell")
    right = packed.withColumn("cell", F.floor(F.col("block") / together)).withColumn("shard", numbers[1]).repartition(tasks, "shard", "cell")

    def run(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        for tree in trees["tree"]:
            tree = MTree.load(tree.as_py())
            for held in blocks["queries"]:
                with np.load(io.BytesIO(held.as_py()), allow_pickle=False) as q:
                    row, ids, x = q["row"], q["ids"], q["x"].astype(np.int64)
                place, near, scores = tree.search_block(x, row, longest, k)
                wide = pa.array([decimal.Decimal(s) for s in scores], pa.decimal128(38, 0)) if scores.dtype == object else pa.array(scores).cast(pa.decimal128(38, 0))
                found.append(pa.table([pa.array(row[place]), pa.array(ids[place]), pa.array(near), wide], FOUND))
        return pa.concat_tables(found) if found else pa.table([[]] * 4, pa.schema(list(zip(FOUND, [*[pa.int64()] * 3, pa.decimal128(38, 0)], strict=True))))

    cells = left.groupBy("shard", "cell").cogroup(right.groupBy("shard", "cell"))
    found = cells.applyInArrow(run, "row long, query_id long, vec_id long, score decimal(38,0)")
    place = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: The stated query set against all rows. Sums of whole products, exact in DuckDB's wide integers.
OP2_SQL = f"""
WITH v AS (
  SELECT vec_id, [CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x, row_number() OVER () AS rid
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL 
    AND len([1 FOR c IN embedding IF c IS NULL OR isnan(c) OR isinf(c)]) = 0),
e AS (SELECT rid, vec_id, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM v),
s AS (SELECT q.rid AS qid, q.vec_id AS query_id, e.rid, e.vec_id, CAST(sum(q.c * e.c) AS BIGINT) AS score
      FROM e q JOIN e ON q.i = e.i AND q.rid <> e.rid WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
