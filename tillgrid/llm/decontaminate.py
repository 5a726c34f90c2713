"""Benchmark decontamination with suffix arrays over the training text.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII
characters. Each task cuts its documents into shards of bounded size and
builds a suffix array over each shard's words. Every suffix of every test
item is then binary-searched, word by word: the suffixes of the shard that
share its first words are one interval, which gives all places of a window of
``window`` words, and narrowing goes on until the interval is empty, which
gives the longest verbatim match and where it lies. Suffixes that no test
item can match for a whole window, because one of its words occurs in no item,
are left out of the array; nothing is lost by that.

Items reach the tasks in blocks of bounded size, so a large test collection
means more blocks, not more memory. An item of fewer words than the window is
one window; an item without words (null, empty) has none. Null or empty
documents have no words and are clean. Repeated items count once by their id;
items without an id mark words but are not listed. Documents are never
grouped, so repeated ids, null ids and other columns are carried as they are.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.testdata import table
from .common import documents, map_arrow, slices

WINDOW = 10
#: Bytes of item text in a block, and of training text in a shard.
BLOCK, SHARD = 4 << 20, 4 << 20

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEPT).split()


class Items:
    """A block of test items: word numbers, and every window with the items that hold it."""

    def __init__(self, rows: list[tuple[object, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        texts = [(k, [number(w, len(self.vocabulary) + 1) for w in words(text)]) for k, text in rows]
        texts = [(k, x) for k, x in texts if x]
        self.ids = [k for k, _ in texts]
        self.sizes = np.array([len(x) for _, x in texts], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.text = np.array([w for _, x in texts for w in x], np.int32)
        self.least = int(min([window, *self.sizes.tolist()]))
        seen: dict[bytes, int] = {}
        self.holders: list[set[int]] = []
        starts, lengths = [], []
        for i, (begin, size) in enumerate(zip(self.begin.tolist(), self.sizes.tolist(), strict=True)):
            length = min(window, size)
            for at in range(begin, begin + size - length + 1):
                k = seen.setdefault(self.text[at : at + length].tobytes(), len(self.holders))
                if k == len(self.holders):
                    self.holders.append(set())
                    starts.append(at)
                    lengths.append(length)
                self.holders[k].add(i)
        self.starts, self.lengths = np.array(starts, np.int64), np.array(lengths, np.int64)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) if n else np.zeros(0, np.int64)
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        if not n:
            return order
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class Shard:
    """The words of some documents, numbered by a block's vocabulary, and their suffix array."""

    def __init__(self, docs: list[list[bytes]], items: Items):
        get = items.vocabulary.get
        self.sizes = np.array([len(x) for x in docs], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        symbols = np.concatenate([np.fromiter((get(w, 0) for w in x), np.int32, len(x)) for x in docs]) if docs else np.zeros(0, np.int32)
        # Runs of known words within one document, of at least the shortest window.
        border = np.ones(len(symbols) + 1, bool)
        border[1:-1] = (self.doc[1:] != self.doc[:-1]) | ((symbols[1:] == 0) | (symbols[:-1] == 0))
        at = np.flatnonzero(border)
        first, size = at[:-1], np.diff(at)
        good = (size >= items.least) & (symbols[first] > 0) if len(first) else np.zeros(0, bool)
        first, size = first[good], size[good]
        # Each run is followed by a zero, which no test word equals.
        total = int(size.sum()) + len(size)
        place = np.arange(total) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1) + np.repeat(first, size + 1)
        stop = np.zeros(total, bool)
        stop[np.cumsum(size + 1) - 1] = True
        self.text = np.where(stop, 0, symbols[np.minimum(place, max(len(symbols) - 1, 0))] if total else 0).astype(np.int32)
        self.place = place
        self.order = suffix_array(self.text)

    def narrow(self, low: np.ndarray, high: np.ndarray, depth: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each interval of suffixes, the part whose word ``depth`` is ``symbol``."""

        def bisect(low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
            low, high = low.copy(), high.copy()
            while (open_ := low < high).any():
                middle = (low + high) // 2
                at = self.order[np.minimum(middle, len(self.order) - 1)] + depth
                found = np.where(at < len(self.text), self.text[np.minimum(at, len(self.text) - 1)], -1)
                below = open_ & ((found <= symbol) if right else (found < symbol))
                low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
            return low

        start = bisect(low, high, False)
        return start, bisect(start, high, True)

    def intervals(self, items: Items, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each window."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        for depth in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((low < high) & (depth < lengths))
            if not len(live):
                break
            low[live], high[live] = self.narrow(low[live], high[live], depth, items.text[starts[live] + depth])
        return low, high

    def hits(self, items: Items) -> tuple[np.ndarray, list[set]]:
        """Which words lie in a window, and the items with windows in each document."""
        low, high = self.intervals(items, items.starts, items.lengths)
        count = np.maximum(high - low, 0)
        query = np.repeat(np.arange(len(count)), count)
        suffix = self.order[np.repeat(low, count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)] if len(query) else np.zeros(0, np.int64)
        at = self.place[suffix]
        change = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + items.lengths[query], -1)
        found: list[set] = [set() for _ in self.sizes]
        pairs = np.unique(np.stack([self.doc[at], query]), axis=1) if len(query) else np.zeros((2, 0), np.int64)
        for doc, q in pairs.T.tolist():
            found[doc].update(items.ids[i] for i in items.holders[q])
        return np.cumsum(change)[:-1] > 0, found

    def longest(self, items: Items, window: int) -> Iterator[tuple[int, int, int, int]]:
        """For each test suffix that matches a whole window: its place in the item
        text, the most words that match anywhere in the shard, and the document and word where."""
        left = np.repeat(items.begin + items.sizes, items.sizes) - np.arange(len(items.text))
        full = np.repeat(np.minimum(window, items.sizes), items.sizes)
        starts = np.flatnonzero(left >= full)
        low, high = self.intervals(items, starts, full[starts])
        live = np.flatnonzero(low < high)
        starts, low, high, depth = starts[live], low[live], high[live], full[starts[live]]
        growing = np.arange(len(starts))
        while len(growing):
            growing = growing[depth[growing] < left[starts[growing]]]
            for d in np.unique(depth[growing]):
                g = growing[depth[growing] == d]
                a, z = self.narrow(low[g], high[g], int(d), items.text[starts[g] + d])
                more = g[a < z]
                low[more], high[more], depth[more] = a[a < z], z[a < z], d + 1
                growing = np.setdiff1d(growing, g[a >= z])
        for s, a, d in zip(starts.tolist(), low.tolist(), depth.tolist(), strict=True):
            at = int(self.place[self.order[a]])
            doc = int(self.doc[at])
            yield s, d, doc, at - int(self.begin[doc])


def item_blocks(benchmark: DataFrame, window: int, block: int = BLOCK) -> list:
    """The test items, dealt by hash into broadcast blocks of about ``block`` bytes of text."""
    rows = benchmark.select("item_id", "text").where("text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n, context = -(-size // block), benchmark.sparkSession.sparkContext
    blocks = []
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        items = Items([(r["item_id"], r["text"].encode()) for r in own.orderBy("item_id", "text").collect()], window)
        if items.ids:
            blocks.append(context.broadcast(items))
    return blocks


def _search(texts: pa.Array, blocks: list) -> tuple[list[int], np.ndarray, list[set]]:
    """Words, hit words and items of each text of a shard."""
    docs = [words(x.as_py()) for x in texts.cast(pa.binary())]
    hit, found = np.zeros(sum(map(len, docs)), bool), [set() for _ in docs]
    for block in blocks:
        shard = Shard(docs, block.value)
        own, listed = shard.hits(block.value)
        hit |= own
        for a, b in zip(found, listed, strict=True):
            a |= b
        if len(blocks) > 1:
            del block._value  # the next use reads it from the worker's disk again
    sizes = [len(x) for x in docs]
    ends = np.cumsum([0, *sizes])
    total = np.concatenate([[0], np.cumsum(hit)])
    return sizes, total[ends[1:]] - total[ends[:-1]], found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted ids as text), ``contaminated``."""
    blocks = item_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD):
            sizes, hits, found = _search(batch.column("text"), blocks)
            ids = [sorted(str(k) for k in x if k is not None) for x in found]
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()),
                                   pa.array(ids, pa.list_(pa.string())), pa.array(hits > 0)], ["doc_id", "n_words", "n_hit", "items", "contaminated"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, contaminated boolean")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id``, ``item_start``, ``n_words``, ``doc_id``, ``doc_start``: for every test suffix with
    a whole window in some document, its longest verbatim match over all shards and one place of it."""
    blocks = item_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD):
            texts = [words(x.as_py()) for x in batch.column("text").cast(pa.binary())]
            for block in blocks:
                items = block.value
                rows = list(Shard(texts, items).longest(items, window))
                owner = np.searchsorted(items.begin, [r[0] for r in rows], side="right") - 1
                yield pa.record_batch([
                    pa.array([str(items.ids[i]) if items.ids[i] is not None else None for i in owner], pa.string()),
                    pa.array([r[0] - int(items.begin[i]) for r, i in zip(rows, owner, strict=True)], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    batch.column("doc_id").take(pa.array([r[2] for r in rows], pa.int64())), pa.array([r[3] for r in rows], pa.int64())],
                    ["item_id", "item_start", "n_words", "doc_id", "doc_start"])

    kind = dict(docs.dtypes)["doc_id"]
    found = map_arrow(docs.select("doc_id", "text"), run, f"item_id string, item_start long, n_words long, doc_id {kind}, doc_start long")
    best = found.groupBy("item_id", "item_start").agg(F.max(F.struct("n_words", (-F.col("doc_id")).alias("d"), (-F.col("doc_start")).alias("s"))).alias("m"))
    return best.select("item_id", "item_start", "m.n_words", (-F.col("m.d")).alias("doc_id"), (-F.col("m.s")).alias("doc_start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of a test item; no shuffle, all columns kept."""
    blocks = item_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD):
            yield batch.filter(pa.array(_search(batch.column("text"), blocks)[1] == 0))

    return map_arrow(docs, run, docs.schema)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
