"""MinHash near-duplicates by a chosen-path set similarity join.

A text's words are lower-cased (A-Z) runs without ASCII white space; its set
holds the distinct shingles of ``shingle`` consecutive words (fewer words: the
whole sequence). Documents with equal sets are one member, so copies cost one
comparison in all. Members are linked when 100 * intersection >= 80 * union.

Trees. A member has 64 minwise tokens (the least hash of its set under each of
64 functions). In a tree's node, a hash of the path so far chooses ``BRANCHES``
of the functions not yet on the path, and each member goes to the children that
its tokens under these name. A pair of similarity s shares both children with
chance s**2 and one with 2 s (1 - s), so at 0.8 it stays together in a tree of any depth with
chance 0.93 at least, and in one of four independent trees with 0.99998; unlike members part at
every step. The first levels are walked without a shuffle, as a path is a function
of the member alone.

Nodes. A node whose members are all linked already is done. In one of at most ``TINY``
members all are candidates; in a larger one all members are compared with the few that
occur in most nodes, which unites a group of near copies. What is then still open is a
small node if at most ``LEAF`` members are outside its largest component: these are
compared with all its members of other components. Larger nodes go on to their children; at
level ``DEEPEST`` all that is left counts as small, so nothing is capped. Joins on a node
are split by adaptive execution, and small nodes are compared in tiles of bounded size, so no
task holds a node.

Links. Candidates whose sizes rule the similarity out never leave the join. Of the
others, those whose minwise tokens (a byte of each) agree in less than ``LIKELY`` go (at a
similarity of 0.8 a chance below 10**-5); the rest are confirmed on the full sets
of 64-bit shingle hashes. Tiles hold full sets: a product of their incidence matrices
gives all intersections at once, and of the links between two components one leaves the
task. Components come from confirmed links only.

Null text and texts without words have the empty set, are linked with nothing
and are their own component. Null ids get their set's component; only ids that are not null
can name it; a component without any has a null id, and then its rows are kept.
Repeated rows stay and share a component. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, documents, map_arrow, remove, slices
from .components import connected_components
from .words import shingle_hashes

SHINGLE, PERCENT = 4, 80
#: Independent trees, children of a node, levels walked before nodes are counted, and the last level.
TREES, BRANCHES, START, DEEPEST = 4, 2, 2, 8
#: Members of a tiny node, members outside the largest component of a small one, members of a large one that all others meet.
TINY, LEAF, HUBS = 16, 1024, 3
#: Members and hashes that a tile of a small node holds on average, and columns of a product of tiles.
TILE, TILE_HASHES, COLUMNS = 256, 1 << 15, 1 << 12
#: Pairs of tiles in a task, and the most tasks.
PAIRS, MOST_TASKS = 8, 20_000
#: Tiles of a node that a tile is compared with in one task, and tiles that are compared with them together.
SLICE, BLOCK = 64, 4
#: Minwise tokens, and the share of equal ones below which a candidate isn't looked at.
TOKENS, LIKELY = 64, 0.55
#: Hashes that are signed at once.
STEP = 1 << 16

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 2**63, TOKENS, np.uint64) << np.uint64(1) | np.uint64(1)
_ADDED = _RANDOM.integers(0, 2**63, TOKENS, np.uint64)
_CHOICE = _RANDOM.integers(0, 2**63, TOKENS, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on every bit of ``x``."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def minwise(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of 32-bit tokens for each run of ``hashes`` that begins at ``starts`` (none empty)."""
    out = np.empty((len(starts), TOKENS), np.uint32)
    for i in range(TOKENS):
        out[:, i] = np.minimum.reduceat((hashes * _FACTORS[i] + _ADDED[i]) >> np.uint64(32), starts)
    return out


def signed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: ``doc_id``, ``th`` (the text's hash), ``n`` (size of its set), ``s1``, ``s2`` (the set's 128-bit hash), ``tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            sets = [np.unique(shingle_hashes(x.as_py() or b"", shingle)) for x in batch.column("text").cast(pa.binary())]
            n = np.array([len(x) for x in sets], np.int64)
            name = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) for x in sets]).reshape(-1, 2)
            tokens: list[bytes | None] = [None] * len(sets)
            used, first = np.flatnonzero(n), 0
            while first < len(used):  # runs of sets that hold about STEP hashes
                last = first + max(1, int(np.searchsorted(np.cumsum(n[used[first:]]), STEP)))
                rows = used[first:last]
                for i, x in zip(rows.tolist(), minwise(np.concatenate([sets[i] for i in rows]), np.cumsum(n[rows]) - n[rows]), strict=True):
                    tokens[i] = x.tobytes()
                first = last
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(n), pa.array(name[:, 0]), pa.array(name[:, 1]),
                                   pa.array(tokens, pa.binary())], ["doc_id", "th", "n", "s1", "s2", "tokens"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, th long, n long, s1 long, s2 long, tokens binary"
    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), run, schema)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def children(key: np.ndarray, used: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys and used functions (as bits) of each path's ``BRANCHES`` next nodes."""
    order = mixed(key[:, None] ^ _CHOICE[None])
    order[(used[:, None] >> np.arange(TOKENS, dtype=np.uint64) & np.uint64(1)).astype(bool)] = np.uint64(2**64 - 1)
    chosen = np.argpartition(order, BRANCHES - 1, axis=1)[:, :BRANCHES]
    token = np.take_along_axis(tokens, chosen, 1).astype(np.uint64)
    step = mixed(token << np.uint64(8) | chosen.astype(np.uint64))
    return mixed(key[:, None] * np.uint64(3) ^ step), used[:, None] | np.uint64(1) << chosen.astype(np.uint64)


def first_nodes(members: DataFrame, trees: int = TREES, start: int = START) -> DataFrame:
    """``key``, ``used``, ``member``, ``n``: each member's nodes at level ``start`` of every tree."""
    roots = mixed(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rows = _tokens(batch.column("tokens")), np.repeat(np.arange(batch.num_rows), trees)
            key, used = np.tile(roots, batch.num_rows), np.zeros(len(rows), np.uint64)
            for _ in range(start):
                key, used = (x.ravel() for x in children(key, used, tokens[rows]))
                rows = np.repeat(rows, BRANCHES)
            at = pa.array(rows)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(used.view(np.int64)), batch.column("member").take(at), batch.column("n").take(at)],
                                  ["key", "used", "member", "n"])

    return map_arrow(members.select("member", "n", "tokens"), run, "key long, used long, member long, n long")


def next_nodes(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The nodes below those of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, used = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "used"))
            key, used = (x.ravel() for x in children(key, used, _tokens(batch.column("tokens"))))
            at = pa.array(np.repeat(np.arange(batch.num_rows), BRANCHES))
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(used.view(np.int64)), batch.column("member").take(at), batch.column("n").take(at)],
                                  ["key", "used", "member", "n"])

    joined = rows.select("key", "used", "member", "n").join(held.select("member", "tokens"), "member")
    return map_arrow(joined.select("key", "used", "member", "n", "tokens"), run, "key long, used long, member long, n long")


def open_nodes(rows: DataFrame, components: DataFrame | None) -> DataFrame:
    """``rows`` of nodes with several components, with ``c`` (the member's), ``main`` (the node's largest), ``size``,
    ``outside`` (members in others) and ``hashes`` (the sum of ``n``); written."""
    if components is None:
        placed = rows.withColumn("c", F.col("member"))
    else:
        small = bounded_broadcast(components, components.count(), 32)
        placed = cut(rows.join(small, rows["member"] == small["node"], "left").select("key", "used", "member", "n", F.coalesce("component", "member").alias("c")), "path-members")
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n")).groupBy("key").agg(
        F.sum("m").alias("size"), F.sum("n").alias("hashes"), F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("parts"))
    open_ = cut(parts.where("parts > 1").select("key", "size", "hashes", F.col("top.c").alias("main"), (F.col("size") - F.col("top.m")).alias("outside")), "open-nodes")
    out = cut(placed.join(bounded_broadcast(open_, open_.count(), 64), "key"), "open-members")
    remove(open_, *([] if components is None else [placed]))
    return out


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def candidates(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a``, ``b`` (members, a < b): all of tiny nodes, and every member of the others with the node's hubs."""
    tiny, large = nodes.where(F.col("size") <= TINY), nodes.where(F.col("size") > TINY)
    x = tiny.select("key", F.col("member").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"))
    y = tiny.select("key", F.col("member").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"))
    pairs = x.join(y, (x["key"] == y["key"]) & (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & _near_sizes(F.col("nx"), F.col("ny"), percent)).select("x", "y")
    often = large.groupBy("member").agg(F.count("*").alias("nodes"))
    best = Window.partitionBy("key").orderBy(F.desc("nodes"), "member")
    hubs = large.select("key", "member", "n").join(often, "member").withColumn("place", F.row_number().over(best)).where(F.col("place") <= HUBS)
    hubs = hubs.select("key", F.col("member").alias("x"), F.col("n").alias("nx"))
    y = large.select("key", F.col("member").alias("y"), F.col("n").alias("ny"))
    pairs = pairs.union(y.join(hubs, "key").where((F.col("x") != F.col("y")) & _near_sizes(F.col("nx"), F.col("ny"), percent)).select("x", "y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def tile_links(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The places of the sets of ``left`` and ``right`` that are similar, by exact intersections."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    row = [np.repeat(np.arange(len(n)), n) for n in sizes]
    common = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    shared = np.zeros((len(left), len(right)), np.float32)  # sizes stay far below 2**24
    for first in range(0, len(common), COLUMNS):
        part = common[first : first + COLUMNS]
        held = []
        for hashes, rows, n in zip(flat, row, sizes, strict=True):
            at = np.minimum(np.searchsorted(part, hashes), len(part) - 1)
            inside = part[at] == hashes
            matrix = np.zeros((len(n), len(part)), np.float32)
            matrix[rows[inside], at[inside]] = 1
            held.append(matrix)
        shared += held[0] @ held[1].T
    union = sizes[0][:, None] + sizes[1][None] - shared
    return np.nonzero(100.0 * shared.astype(np.float64) >= float(percent) * union.astype(np.float64))


def small_node_links(nodes: DataFrame, held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (``a``, ``b``) between the members outside each node's largest component and all of its members, at most one
    for two components of a pair of tiles; written."""
    tiles = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / TILE), F.ceil(F.col("hashes") / TILE_HASHES))
    placed = nodes.select("key", "member", "c", (F.col("c") != F.col("main")).alias("out"), tiles.alias("tiles"))
    written = cut(placed.withColumn("tile", F.pmod(F.xxhash64("member"), F.col("tiles"))), "tile-members")
    filled = bounded_broadcast(written, written.count(), 64).join(held.select("member", "hashes"), "member").groupBy("key", "out", "tile").agg(
        F.collect_list(F.struct("member", "c", "hashes")).alias("sets"), F.max("tiles").alias("tiles"))
    filled = cut(filled, "node-tiles", "zstd")
    # Sets are dealt by a block of left tiles and a slice of the right ones: a pair of tiles is made where it is compared,
    # and a right tile is dealt once for a block.
    block = F.expr(f"tile div {BLOCK}")
    outer = filled.where("out").groupBy("key", block.alias("block")).agg(F.min("tile").alias("least"))
    blocks = cut(outer, "tile-blocks")
    outer = bounded_broadcast(blocks, blocks.count(), 40)
    x = filled.where("out").select("key", block.alias("block"), F.col("tile").alias("tx"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tiles - 1) div {SLICE}"))).alias("slice"), F.col("sets").alias("left"))
    y = filled.select("key", F.col("tile").alias("ty"), F.expr(f"tile div {SLICE}").alias("slice"), F.col("out").alias("oy"), F.col("sets").alias("right"))
    y = y.join(outer, "key").where(~F.col("oy") | (F.col("least") <= F.col("ty"))).select("key", "block", "slice", "ty", "oy", "right")
    # Tasks follow the number of pairs, not the bytes of tiles that the join reads.
    cells = filled.groupBy("key").agg((F.count_if("out") * F.count("*")).alias("cells")).agg(F.sum("cells")).first()[0] or 0
    tasks, by = max(1, min(MOST_TASKS, -(-cells // PAIRS))), ["key", "block", "slice"]
    pairs = x.repartition(tasks, *by).join(y.repartition(tasks, *by).hint("merge"), by).where(~F.col("oy") | (F.col("tx") <= F.col("ty")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for name in ("left", "right"):
                    rows = batch.column(name)[i].values
                    sides.append((rows.field("member").to_numpy(), rows.field("c").to_numpy(), [np.frombuffer(h.as_py(), np.uint64) for h in rows.field("hashes")]))
                (ma, ca, a), (mb, cb, b) = sides
                p, q = tile_links(a, b, percent)
                p, q = p[ca[p] != cb[q]], q[ca[p] != cb[q]]
                _, first = np.unique(np.stack([ca[p], cb[q]]), axis=1, return_index=True)
                yield pa.record_batch([pa.array(ma[p[first]]), pa.array(mb[q[first]])], ["a", "b"])

    links = cut(map_arrow(pairs.select("left", "right"), run, "a long, b long"), "set-links")
    remove(written, filled, blocks)
    return links


def confirmed(pairs: DataFrame, held: DataFrame, percent: int = PERCENT, likely: float = LIKELY) -> DataFrame:
    """The pairs that are linked, by their full sets."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, TOKENS) for c in ("ta", "tb"))
            equal = np.equal(*marks).mean(1)
            yield batch.select(["a", "b"]).filter(pa.array(equal >= likely))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    a, b = (held.select(F.col("member").alias(c), F.col("marks").alias(f"t{c}")) for c in "ab")
    near = cut(map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb"), estimate, "a long, b long"), "likely-pairs")
    # Few pairs go to the sets, not the sets to them; only their own sets are dealt then.
    near = bounded_broadcast(near, near.count(), 32)
    a, b = (held.select(F.col("member").alias(c), F.col("hashes").alias(f"x{c}")) for c in "ab")
    return cut(map_arrow(near.join(a, "a").join(b, "b").select("a", "b", "xa", "xb"), exact, "a long, b long"), "set-links")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``member``, ``tokens``, ``marks`` (a byte of each token), ``hashes`` (sorted 64-bit shingle hashes) of the members ``wanted``; written."""

    def with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _tokens(batch.column("tokens")).astype(np.uint8)
            yield pa.record_batch([*(batch.column(c) for c in ("member", "tokens", "hashes")), pa.array([x.tobytes() for x in marks], pa.binary())],
                                  ["member", "tokens", "hashes", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            sets = [np.unique(shingle_hashes(x.as_py() or b"", shingle)).tobytes() for x in batch.column("text").cast(pa.binary())]
            name = np.array([np.frombuffer(xxhash.xxh3_128_digest(x), np.int64) for x in sets]).reshape(-1, 2)
            yield pa.record_batch([pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(sets, pa.binary())], ["s1", "s2", "hashes"])

    texts = wanted.select("th").distinct()
    own = docs.select("text", F.xxhash64("text").alias("th")).join(bounded_broadcast(texts, wanted.count(), 32), "th", "left_semi").dropDuplicates(["th", "text"])
    named = map_arrow(own.select("text"), run, "s1 long, s2 long, hashes binary").join(wanted, ["s1", "s2"])
    return cut(map_arrow(named.select("member", "tokens", "hashes"), with_marks, "member long, tokens binary, hashes binary, marks binary"), "full-sets", "zstd")


def linked(docs: DataFrame, members: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, start: int = START,
           leaf: int = LEAF, deepest: int = DEEPEST) -> DataFrame | None:
    """``node``, ``component`` for the members that are linked to others; None if there are none."""
    nodes = first_nodes(members, trees, start)
    shared = cut(nodes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "shared-nodes")
    rows = cut(nodes.join(bounded_broadcast(shared, shared.count(), 32), "key", "left_semi"), "path-members")
    wanted = rows.select("member").distinct()
    wanted = cut(members.join(bounded_broadcast(wanted, rows.count(), 32), "member", "left_semi"), "joined-members")
    held = full_sets(docs, wanted, shingle)
    remove(shared, wanted)
    links: list[DataFrame] = []

    def united(found: DataFrame, components: DataFrame | None) -> DataFrame | None:
        if found.isEmpty():
            return components
        links.append(found)
        return cut(connected_components(functools.reduce(DataFrame.union, links)), "set-components")

    components, level = None, start
    while True:
        every = open_nodes(rows, components)
        remove(rows)
        components = united(confirmed(candidates(every, percent), held, percent), components)
        nodes = open_nodes(every.where(F.col("size") > TINY).select("key", "used", "member", "n"), components)
        remove(every)
        small = nodes if level >= deepest else nodes.where(F.col("outside") <= leaf)
        if not small.isEmpty():
            components = united(small_node_links(small, held, percent), components)
        large = nodes.where(F.col("outside") > leaf)
        if level >= deepest or large.isEmpty():
            remove(nodes, held)
            return components
        rows = cut(next_nodes(large, held), "path-members")
        remove(nodes)
        level += 1


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, **tree: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` per row of ``docs``; ``tree``: see `linked`."""
    whole = cut(signed(docs, shingle), "signed-sets")
    sets = whole.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.first(F.struct("th", "n", "tokens")).alias("x"))
    members = cut(sets.select(F.monotonically_increasing_id().alias("member"), "s1", "s2", "first", "x.th", "x.n", "x.tokens"), "set-members")
    own = cut(whole.select("doc_id", "n", "s1", "s2"), "named-sets")
    remove(whole)
    components = linked(docs, members.select("member", "s1", "s2", "th", "n", "tokens"), shingle, percent, **tree)
    named = members.select("s1", "s2", F.col("first").alias("component_id"))
    if components is not None:
        placed = members.select("member", "s1", "s2", "first").join(
            bounded_broadcast(components, components.count(), 32), members["member"] == components["node"], "left").select("s1", "s2", "first", "component")
        placed = cut(placed, "placed-members")
        least = placed.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
        named = placed.join(least, "component", "left").select("s1", "s2", F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    full, empty = own.where("n > 0"), own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    placed = full.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return placed.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
