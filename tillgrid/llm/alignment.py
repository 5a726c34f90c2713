"""Cross-tokenizer alignment: inverted pair bitmaps over a corpus encoded by two tokenizers.

Each text is encoded by a byte-level vocabulary (A, over a space and the text)
and by a piece vocabulary (B, which puts that space itself). Byte offsets where
tokens of both end cut a text into groups; every A token of a group is linked
to every B token of it.

Documents are numbered within containers of 2,048. While a task encodes, it
builds its containers' inverted index: for each id pair a compressed bitmap of
the documents that hold it (a list of places while short, else bits), and
planes of multiplicities: plane p marks the documents whose number of links
less one has bit p. Batches of a container are merged by OR, multiplicities by
addition. Written indexes answer by population counts: a pair's documents are the
sum of its bitmaps' counts over containers, its links add the planes' counts
times their weights. Pair counts then go back to the index in slices of bounded
size, and each pair's postings hand its count to the documents they name, so no
posting is ever shuffled as a row: shuffles carry one row per pair and
container, and one per document and slice.

Token bytes: an A entry byte-level decoded; a B piece in UTF-8 with U+2581 as
a space and <0xHH> as that byte. Texts that are null or empty, or whose joined
token bytes of A or B differ from a space and the text, have no tokens: zeros and
an empty string. Strings of special tokens in a text are plain text. Repeated
rows are documents of their own; a null doc_id is carried as null. An empty table
gives no rows. Other columns are ignored. Groups of more than 65,536 links (a
long text without common borders) are counted by distinct ids, which gives the same links.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, documents, map_arrow, slices
from .tokens import RANKS, _encode_whole, vocabulary_path

PIECES = "piece_bpe_32k.model"
#: Documents in a container, as bits.
BITS = 11
CONTAINER = 1 << BITS
#: A bitmap of more places than this is kept as bits.
SPARSE = CONTAINER // 16
#: Pairs and postings in a written slice of an index; links expanded at once; links of a group from which it is counted by ids.
SLICE, POSTINGS, EXPANDED, LARGE = 1 << 15, 1 << 20, 1 << 22, 1 << 16


class Tokens:
    """One tokenizer: its encoder and its tokens' bytes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: list[bytes]):
        self.encode, self.entries = encode, entries
        self.lengths = np.array([len(x) for x in entries], np.int64)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def byte_tokens(path: str) -> Tokens:
    """A byte-level vocabulary, as ``.tiktoken`` ranks or as ``.json``; special tokens' strings are plain text."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        own = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Tokens(lambda texts: [_encode_whole(own, x) for x in texts], _entries({i: token for token, i in ranks.items()}))
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), byte_letters()
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    entries = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items() if all(c in letters for c in token)}
    return Tokens(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], _entries(entries))


def _entries(by_id: dict[int, bytes]) -> list[bytes]:
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


@functools.lru_cache(maxsize=2)
def piece_tokens(path: str) -> Tokens:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
               for i in range(own.get_piece_size())]
    return Tokens(lambda texts: own.encode(texts, num_threads=1), entries)


class Batch:
    """The tokens and groups of some texts, as flat arrays over all of them."""

    def __init__(self, texts: list[str | None], a: Tokens, b: Tokens):
        shown = [x or "" for x in texts]
        ids_a, ids_b = a.encode([f" {x}" for x in shown]), b.encode(shown)
        for i, x in enumerate(shown):
            raw = f" {x}".encode()
            if not x or b"".join(map(a.entries.__getitem__, ids_a[i])) != raw or b"".join(map(b.entries.__getitem__, ids_b[i])) != raw:
                ids_a[i], ids_b[i] = [], []
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.fromiter((t for x in ids for t in x), np.int64, int(n.sum())) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        ends_a, ends_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        size = int(ends_a[-1]) + 1 if len(ends_a) else 1
        at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        self.last_a, self.last_b = at_b[ends_a], at_a[ends_b]  # the token ends a group
        self.group_a, self.group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        self.groups = int(self.last_a.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        self.doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.doc = self.doc_a[self.last_a]  # of each group
        self.n_groups = np.bincount(self.doc, minlength=len(texts))
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, self.doc, self.in_a * self.in_b)

    def written(self, digits: np.ndarray) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2``."""
        place_a = np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(self.in_a)[self.group_b]
        out = np.zeros((len(self.a) + len(self.b), digits.shape[1] + 1), np.uint8)
        out[place_a, :-1], out[place_b, :-1] = digits[self.a], digits[self.b]
        out[place_a, -1] = np.where(self.last_a, ord("|"), ord(","))
        out[place_b, -1] = np.where(self.last_b, ord(";"), ord(","))
        n = np.cumsum(self.n_a + self.n_b)
        out[n[self.n_a > 0] - 1, -1] = 0  # nothing behind a text's last group
        used = out != 0
        ends = np.cumsum(used.sum(1))
        ends = np.where(n > 0, ends[n - 1], 0) if len(ends) else np.zeros(len(n), np.int64)
        flat = out[used].tobytes()
        return [flat[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def links(self, slots: np.ndarray, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted distinct keys (pair, then slot) and how many links each stands for, a block of groups at a time."""
        sizes = self.in_a * self.in_b
        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        large = sizes > LARGE
        for g in np.flatnonzero(large).tolist():
            a, na = np.unique(self.a[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            b, nb = np.unique(self.b[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            step = max(1, EXPANDED // len(b))
            for i in range(0, len(a), step):
                pairs = (a[i : i + step, None] * n_b + b[None]).ravel()
                yield pairs << BITS | slots[self.doc[g]], (na[i : i + step, None] * nb[None]).ravel()
        small = np.where(large, 0, sizes)
        block = np.cumsum(small) // EXPANDED
        starts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        for lo, hi in zip(starts, [*starts, self.groups][1:], strict=True):
            own = slice(int(first_a[lo]), int(first_a[hi - 1] + self.in_a[hi - 1]))
            group = self.group_a[own]
            repeat = np.where(large[group], 0, self.in_b[group])
            total = int(repeat.sum())
            behind = np.arange(total) - np.repeat(np.cumsum(repeat) - repeat, repeat) + np.repeat(first_b[group], repeat)
            pairs = np.repeat(self.a[own], repeat) * n_b + self.b[behind]
            yield np.unique(pairs << BITS | np.repeat(slots[self.doc[group]], repeat), return_counts=True)


class Bitmaps:
    """Compressed sets of places below `CONTAINER`, one per group: sorted 16-bit places, or bits where those are shorter."""

    FIELDS = ("size", "places", "bits")

    def __init__(self, size: np.ndarray, places: np.ndarray, bits: np.ndarray):
        self.size, self.places, self.bits = size, places, bits

    @classmethod
    def pack(cls, group: np.ndarray, place: np.ndarray, groups: int) -> Bitmaps:
        """From places sorted by group."""
        size = np.bincount(group, minlength=groups).astype(np.int32)
        dense = size > SPARSE
        inside = dense[group]
        held = np.zeros((int(dense.sum()), CONTAINER), bool)
        held[(np.cumsum(dense) - 1)[group[inside]], place[inside]] = True
        return cls(size, place[~inside].astype(np.uint16), np.packbits(held, axis=1, bitorder="little"))

    def popcount(self) -> np.ndarray:
        out = self.size.astype(np.int64)
        out[self.size > SPARSE] = np.bitwise_count(self.bits).sum(1)
        return out

    def unpack(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups and places, sorted."""
        dense = self.size > SPARSE
        row, place = np.nonzero(np.unpackbits(self.bits, axis=1, bitorder="little"))
        group = np.concatenate([np.repeat(np.flatnonzero(~dense), self.size[~dense]), np.flatnonzero(dense)[row]])
        place = np.concatenate([self.places.astype(np.int64), place])
        order = np.argsort(group, kind="stable")
        return group[order], place[order]


class Index:
    """Pairs, the bitmaps of their documents, and planes of (links - 1), each over the pairs that have a bit there."""

    def __init__(self, pairs: np.ndarray, held: Bitmaps, planes: list[tuple[np.ndarray, Bitmaps]]):
        self.pairs, self.held, self.planes = pairs, held, planes

    @classmethod
    def pack(cls, keys: np.ndarray, links: np.ndarray) -> Index:
        """From sorted distinct keys."""
        pairs, group = np.unique(keys >> BITS, return_inverse=True)
        place, planes, more, bit = keys & (CONTAINER - 1), [], links - 1, 0
        while (more >> bit).any():
            on = (more >> bit & 1).astype(bool)
            of, own = np.unique(group[on], return_inverse=True)
            planes.append((of, Bitmaps.pack(own, place[on], len(of))))
            bit += 1
        return cls(pairs, Bitmaps.pack(group, place, len(pairs)), planes)

    def unpack(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each posting's pair (its number here), place and links."""
        group, place = self.held.unpack()
        links, at = np.ones(len(group), np.int64), group << BITS | place
        for bit, (of, plane) in enumerate(self.planes):
            own, where = plane.unpack()
            links[np.searchsorted(at, of[own] << BITS | where)] += 1 << bit
        return group, place, links

    @classmethod
    def merge(cls, parts: list[Index]) -> Index:
        """Bitmaps united, multiplicities added."""
        if len(parts) == 1:
            return parts[0]
        keys, links = [], []
        for x in parts:
            group, place, n = x.unpack()
            keys.append(x.pairs[group] << BITS | place)
            links.append(n)
        return cls.pack(*summed(np.concatenate(keys), np.concatenate(links)))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's documents and links."""
        docs = self.held.popcount()
        links = docs.copy()
        for bit, (of, plane) in enumerate(self.planes):
            links[of] += plane.popcount() << bit
        return docs, links

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = {"pairs": self.pairs, "planes": np.array(len(self.planes))}
        for name, x in [("held", self.held), *((f"plane{i}", x) for i, (_, x) in enumerate(self.planes))]:
            arrays |= {f"{name}_{f}": getattr(x, f) for f in Bitmaps.FIELDS}
        np.savez(out, **arrays, **{f"of{i}": of.astype(np.int32) for i, (of, _) in enumerate(self.planes)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Index:
        with np.load(io.BytesIO(raw), allow_pickle=False) as held:
            read = lambda name: Bitmaps(*(held[f"{name}_{f}"] for f in Bitmaps.FIELDS))
            return cls(held["pairs"], read("held"), [(held[f"of{i}"].astype(np.int64), read(f"plane{i}")) for i in range(int(held["planes"]))])


def summed(keys: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, links = keys[order], links[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(links, first) if len(first) else links


def index(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The written index. Rows of documents: ``container``, ``slot``, ``doc_id``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``groups_sha256``; rows of the index: ``container``, ``slice``, ``part`` (a dumped `Index`)."""
    a_path, b_path = a_path or vocabulary_path(RANKS), b_path or vocabulary_path(PIECES)
    names = ["container", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slice", "part"]

    def closed(container: int, parts: list[Index], ids: pa.DataType) -> Iterator[pa.RecordBatch]:
        whole = Index.merge(parts)
        group, place, links = whole.unpack()
        ends = np.searchsorted(group, np.arange(1, len(whole.pairs) + 1))
        block = np.arange(len(whole.pairs)) // SLICE + ends // POSTINGS
        starts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        for i, (lo, hi) in enumerate(zip(starts, [*starts, len(whole.pairs)][1:], strict=True)):
            own = slice(int(ends[lo - 1]) if lo else 0, int(ends[hi - 1]))
            part = Index.pack(whole.pairs[group[own]] << BITS | place[own], links[own])
            none = [pa.nulls(1, t) for t in (pa.int32(), ids, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.record_batch([pa.array([container], pa.int64()), *none, pa.array([i], pa.int32()), pa.array([part.dump()], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokens(a_path), piece_tokens(b_path)
        n_b, width = len(b.entries), len(str(max(len(a.entries), len(b.entries))))
        digits = np.array([str(i).encode() for i in range(max(len(a.entries), len(b.entries)))], f"S{width}").view(np.uint8).reshape(-1, width)
        container, slot, parts, ids = TaskContext.get().partitionId() << 32, 0, [], pa.null()
        for batch in slices(batches, "text", 2 << 20):
            ids = batch.column("doc_id").type
            while batch.num_rows:
                now = batch.slice(0, CONTAINER - slot)
                batch = batch.slice(now.num_rows)
                found, n = Batch(now.column("text").to_pylist(), a, b), now.num_rows
                slots = np.arange(slot, slot + n)
                parts += [Index.pack(*x) for x in found.links(slots, n_b) if len(x[0])]
                shas = [hashlib.sha256(x).hexdigest() if x else "" for x in found.written(digits)]
                ints = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                yield pa.record_batch([pa.array(np.full(n, container)), pa.array(slots, pa.int32()), now.column("doc_id"), *ints,
                                       pa.array(shas, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
                slot += n
                if slot == CONTAINER:
                    if parts:
                        yield from closed(container, parts, ids)
                    container, slot, parts = container + 1, 0, []
                elif len(parts) >= 8:
                    parts = [Index.merge(parts)]
        if parts:
            yield from closed(container, parts, ids)

    schema = (f"container long, slot int, doc_id {dict(docs.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, n_links long, "
              "groups_sha256 string, slice int, part binary")
    return cut(map_arrow(docs.select("doc_id", "text"), run, schema), "pair-index", "zstd")


def _parts(held: DataFrame) -> DataFrame:
    return held.where("part is not null").select("container", "slice", "part")


def postings_counts(held: DataFrame) -> DataFrame:
    """``container``, ``slice``, ``pair``, ``n_docs``, ``n_links``: population counts of the index's bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for container, part, raw in zip(*(batch.column(c) for c in ("container", "slice", "part")), strict=True):
                own = Index.load(raw.as_py())
                docs, links = own.counts()
                n = len(docs)
                yield pa.record_batch([pa.array(np.full(n, container.as_py())), pa.array(np.full(n, part.as_py(), np.int32)), pa.array(own.pairs),
                                       pa.array(docs), pa.array(links)], ["container", "slice", "pair", "n_docs", "n_links"])

    return map_arrow(_parts(held), run, "container long, slice int, pair long, n_docs long, n_links long")


def pair_counts(held: DataFrame, n_b: int) -> DataFrame:
    """``a``, ``b``, ``n_docs``, ``n_links`` for every linked id pair; ``n_b`` is the size of B's vocabulary."""
    summed_ = postings_counts(held).groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    return summed_.select(F.floor(F.col("pair") / n_b).alias("a"), (F.col("pair") % n_b).alias("b"), "n_docs", "n_links")


def scores(held: DataFrame, n_b: int) -> DataFrame:
    """``container``, ``slot``, ``n_best``, ``count_sum`` for every document with links."""
    # A pair has one row per container, so its window is short against its documents.
    whole = F.sum("n_docs").over(Window.partitionBy("pair"))
    weights = cut(postings_counts(held).select("container", "slice", "pair", whole.alias("count")), "pair-weights")
    weights = weights.withColumn("a", F.floor(F.col("pair") / n_b))
    highest = weights.groupBy("a").agg(F.max("count").alias("highest"))
    highest = bounded_broadcast(highest, len(byte_tokens(vocabulary_path(RANKS)).entries), 64)  # a row per id of A at most
    weighed = weights.join(highest, "a").groupBy("container", "slice").agg(
        F.collect_list(F.struct("pair", "count", (F.col("count") == F.col("highest")).alias("best"))).alias("weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Index.load(batch.column("part")[i].as_py())
                rows = batch.column("weights")[i].values
                pair, count, best = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best"))
                order = np.argsort(pair)
                assert np.array_equal(pair[order], own.pairs)
                count, best = count[order], best[order]
                group, place, links = own.unpack()
                total, n_best = np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64)
                np.add.at(total, place, links * count[group])
                np.add.at(n_best, place, links * best[group])
                used = np.flatnonzero(total)
                yield pa.record_batch([pa.array(np.full(len(used), batch.column("container")[i].as_py())), pa.array(used, pa.int32()),
                                       pa.array(n_best[used]), pa.array(total[used])], ["container", "slot", "n_best", "count_sum"])

    parts = map_arrow(_parts(held).join(weighed, ["container", "slice"]), run, "container long, slot int, n_best long, count_sum long")
    return parts.groupBy("container", "slot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: its tokens, groups, links, and what the corpus-wide pair counts say of them."""
    held = index(docs, a_path, b_path)
    n_b = len(piece_tokens(b_path or vocabulary_path(PIECES)).entries)
    own = held.where("slot is not null").select("container", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return own.join(scores(held, n_b), ["container", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
