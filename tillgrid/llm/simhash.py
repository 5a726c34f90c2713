"""SimHash near-duplicates: fingerprints compared exactly, tile against tile.

A text's words are lower-cased (A-Z) runs without ASCII white space; its
shingles are ``shingle`` consecutive words joined by one space, repeats
included (a shorter text is one shingle; a text without words has
fingerprint zero and links like any other). Each shingle is hashed by XXH64
with seed 42, and a fingerprint bit is 1 if more than half of the hashes set
it. Fingerprints within ``radius`` bits are linked and documents take the
component of their fingerprint.

Equal fingerprints are compared once. Distinct ones are dealt into tiles of
one population count each; two fingerprints whose counts differ by more than
the radius can't be within it, so such tile pairs are never formed. Inside a
pair, numpy compares sub-tiles by exclusive-or and bit counts, again skipping
those whose counts by 16-bit part differ too much in sum. A task returns a
spanning forest of the links it found, not the links, so a group of copies
costs edges in proportion to its members.

Null text has no words. Null ids get their fingerprint's component; among
members only ids that are not null can name it. Repeated rows stay and share a
component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, documents, map_arrow, slices
from .components import connected_components

SHINGLE, RADIUS = 4, 4
#: Fingerprints in a tile, and in a sub-tile inside a task.
TILE, SUB = 8192, 512
#: Tile pairs compared by one task.
PAIRS = 6
#: Shingles hashed at once.
STEP = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    raw = np.frombuffer(text.lower(), np.uint8)  # bytes.lower() changes A-Z only
    space = _SPACE[raw]
    keep = ~space
    keep[1:] |= keep[:-1].copy()  # a word's bytes and one separator behind it
    joined, space = np.where(space, np.uint8(0x20), raw)[keep], space[keep]
    ends = np.flatnonzero(space)
    if len(joined) and not space[-1]:
        ends = np.append(ends, len(joined))
    if not len(ends):
        return 0
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(ends) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    data, hashed, ones = joined.tobytes(), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(ends), STEP):
        h = [hashed(data[a:z], 42) for a, z in zip(starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist(), strict=True)]
        octets = np.array(h, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.bitwise_or.reduce(np.uint64(1) << np.flatnonzero(2 * ones > len(ends)).astype(np.uint64), initial=np.uint64(0)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``th`` (the text's hash), ``fp`` (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 32 << 20):
            texts = batch.column("text").cast(pa.binary())
            fp = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), run, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, fp long")


def _parts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _sub_tiles(fp: np.ndarray) -> tuple[np.ndarray, list[slice], np.ndarray, np.ndarray]:
    """Fingerprints ordered by their parts' population counts, with the bounds of each sub-tile."""
    parts = _parts(fp)
    order = np.lexsort((fp, parts[:, 2], parts[:, 0], parts[:, 0] + parts[:, 1]))
    fp, parts = fp[order], parts[order]
    cuts = [slice(i, min(i + SUB, len(fp))) for i in range(0, len(fp), SUB)]
    return fp, cuts, np.array([parts[c].min(0) for c in cuts]), np.array([parts[c].max(0) for c in cuts])


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever links of at most ``radius`` bits connect, one per
    member at most: between ``left`` and ``right``, or inside ``left`` if ``right`` is None."""
    a, a_cuts, a_low, a_high = _sub_tiles(left)
    b, b_cuts, b_low, b_high = (a, a_cuts, a_low, a_high) if right is None else _sub_tiles(right)
    shift = 0 if right is None else len(a)
    nodes = a if right is None else np.concatenate([a, b])
    root = np.arange(len(nodes))
    apart = np.maximum(0, np.maximum(a_low[:, None] - b_high[None], b_low[None] - a_high[:, None])).sum(2)
    for i, j in np.argwhere(apart <= radius):
        if right is None and j < i:
            continue
        near = np.bitwise_count(a[a_cuts[i], None] ^ b[None, b_cuts[j]]) <= radius
        x, y = np.nonzero(near)
        x, y = root[x + a_cuts[i].start], root[y + b_cuts[j].start + shift]
        while (different := x != y).any():
            low, high = np.minimum(x, y)[different], np.maximum(x, y)[different]
            np.minimum.at(root, high, low)
            while (root != (up := root[root])).any():
                root = up
            x, y = root[low], root[high]
    held = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[held], nodes[root[held]]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (``a``, ``b``) among the distinct fingerprints ``fp`` that keep the components of all links."""
    counted = distinct.select("fp", F.bit_count("fp").alias("p"))
    sizes = {r["p"]: -(-r["n"] // tile) for r in counted.groupBy("p").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    if not sizes:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    chunks = F.create_map(*[F.lit(int(x)) for p in sorted(sizes) for x in (p, sizes[p])])
    tiles = cut(counted.groupBy("p", F.pmod(F.xxhash64("fp"), chunks[F.col("p")]).alias("c")).agg(F.collect_list("fp").alias("fps")), "fingerprint-tiles")
    near = F.filter(F.sequence("p", F.col("p") + radius), lambda q: F.array_contains(F.map_keys(chunks), q))
    partners = F.flatten(F.transform(near, lambda q: F.transform(
        F.sequence(F.lit(0), chunks[q] - 1), lambda k: F.struct(q.alias("p"), k.cast("long").alias("c")))))
    left = tiles.select(F.col("p").alias("lp"), F.col("c").alias("lc"), F.col("fps").alias("left"), F.explode(partners).alias("to")).select(
        "lp", "lc", "left", "to.p", "to.c").where("p > lp or c >= lc")
    # Tiles are small, their comparison isn't: tasks follow the number of pairs, not the bytes.
    cells = sum(a * (a + 1) // 2 + a * sum(sizes.get(q, 0) for q in range(p + 1, p + radius + 1)) for p, a in sizes.items())
    dealt = left.join(tiles, ["p", "c"]).repartition(max(1, -(-cells // PAIRS)), "lp", "lc", "p", "c")
    pairs = dealt.select((F.expr("p = lp and c = lc")).alias("own"), "left", F.expr("if(p = lp and c = lc, null, fps)").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column("left")[k], batch.column("right")[k]
                a, b = forest(np.array(left.values).view(np.uint64), None if not right.is_valid else np.array(right.values).view(np.uint64), radius)
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return map_arrow(pairs, run, "a long, b long")


def _placed(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """``doc_id``, ``th``, ``fp``, ``component`` (its smallest fingerprint), ``component_id`` per row of ``docs``."""
    prints = cut(fingerprints(docs, shingle), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    linked = connected_components(fingerprint_links(distinct.select("fp"), radius))
    member = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    member = cut(member, "fingerprint-members")
    named = member.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(member.join(named, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "th", "fp", "component", "component_id")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``th``, ``fp``, ``component_id`` (the smallest doc_id in the component) per row of ``docs``."""
    return _placed(docs, shingle, radius).drop("component")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id.

    If several rows of a component have this id, of different texts that
    with the smallest hash stays, of equal ones any one row. An id that lies
    in several components is chosen in each of them on its own. Rows without
    an id stay.
    """
    found = _placed(docs.where("doc_id is not null"), shingle, radius).where("doc_id = component_id")
    texts = found.groupBy("component", "doc_id", "th").agg(F.count("*").alias("n"))
    # A text lies in one component, so id and text name the component's row.
    first = cut(texts.groupBy("component").agg(F.min(F.struct("doc_id", "th", "n")).alias("x")).select("x.doc_id", "x.th", "x.n"), "kept-documents")
    counts = first.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") > 1)).first()

    def rows(chosen: DataFrame, n: int) -> DataFrame:
        side = bounded_broadcast(chosen.select("doc_id", "th"), n, 32)
        return docs.join(side, (docs["doc_id"] == side["doc_id"]) & (F.xxhash64(docs["text"]) == side["th"]), "left_semi")

    kept = rows(first.where("n = 1"), counts[0]).unionByName(docs.where("doc_id is null"))
    if counts[1]:
        column = "row_of_id"
        while column in docs.columns:
            column += "_"
        place = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        again = rows(first.where("n > 1"), counts[1]).withColumn(column, F.row_number().over(place))
        kept = kept.unionByName(again.where(F.col(column) == 1).drop(column))
    return kept


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
