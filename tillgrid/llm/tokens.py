"""Encoded documents: ids of a public byte-level vocabulary, one Arrow batch at a time."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_arrow, slices

#: The file of the default vocabulary and the same vocabulary as ranks, in the public tokenizer folder.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: White space of this many characters is cut out for `tiktoken`, whose pattern overflows its stack on a million.
BLANKS = 1 << 16
#: What the pattern's \s matches (Python's also takes U+001C to U+001F).
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % BLANKS)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to id lists, loaded once per Python worker.

    ``.json`` files are read by `tokenizers`: the strings of added tokens give
    their ids wherever a text holds them, and none is put around a text.
    ``.tiktoken`` files are read by `tiktoken`, with the added tokens of the
    ``.json`` file of the same name, if any; the same vocabulary gives the same
    ids there at several times the speed (tests compare the two on every kind
    of text).
    """
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = _added_tokens(path.removesuffix(".tiktoken") + ".json")
        if not added:
            return lambda texts: [_encode_whole(own, x) for x in texts]
        between = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")

        def encode(text: str) -> list[int]:
            parts = between.split(text)
            ids = _encode_whole(own, parts[0])
            for token, part in zip(parts[1::2], parts[2::2], strict=True):
                ids.append(added[token])
                ids += _encode_whole(own, part)
            return ids

        return lambda texts: [encode(x) for x in texts]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]


def _added_tokens(path: str) -> dict[str, int]:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def _encode_whole(own, text: str) -> list[int]:
    """The ids of a text of any length. A long run of white space is one piece; if more text
    follows, its last character goes to that, as the pattern has it."""
    if len(text) < BLANKS:
        return own.encode_ordinary(text)
    ids, at = [], 0
    for run in _LONG_BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += own.encode_ordinary(text[at : run.start()])
        ids += own._encode_single_piece(text[run.start() : end])
        at = end
    return ids + own.encode_ordinary(text[at:])


def token_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per document: ``n_tokens``, the ids of its whole text (null: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, "text"):
            ids = encode([x or "" for x in batch.column("text").to_pylist()])
            yield pa.record_batch([pa.array([len(x) for x in ids], pa.int64())], ["n_tokens"])

    return map_arrow(docs.select(docs[text].alias("text")), run, "n_tokens long")


def token_streams(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids with ``end_id`` behind them, as it lies in its partition.

    Rows: ``doc_id``, ``part`` (the partition), ``start`` (ids before it in
    that partition), ``n`` and ``ids`` (little-endian; two bytes an id when
    all ids fit, else four, named by ``width``). Meant to be written at once:
    the partition numbers hold for that one run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 4 << 20):
            ids = [np.array([*x, end_id], "<u4") for x in encode([x or "" for x in batch.column("text").to_pylist()])]
            n = np.array([len(x) for x in ids], np.int64)
            width = np.array([2 if x.max() < 1 << 16 else 4 for x in ids], np.int32)
            begin = start + np.cumsum(n) - n
            start += int(n.sum())
            packed = [x.astype(f"<u{w}").tobytes() for x, w in zip(ids, width, strict=True)]
            yield pa.record_batch([batch.column(key), pa.array(np.full(len(n), part, np.int32)), pa.array(begin), pa.array(n),
                                   pa.array(width), pa.array(packed, pa.binary())], ["doc_id", "part", "start", "n", "width", "ids"])

    kind = dict(docs.dtypes)[key]
    return map_arrow(docs.select(docs[key].alias(key), docs[text].alias("text")), run, f"doc_id {kind}, part int, start long, n long, width int, ids binary")
