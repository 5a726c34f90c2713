"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is a sequence of words (runs of letters, digits and underscores) and
of punctuation runs; its features are the words, a word's letter case when it
isn't plain lower case, and pairs of neighbours, where a word behind itself (or
behind itself and one more) is one feature of its own whatever the word. Features are hashed into a fixed
number of weights. A feature's value is its share of the text's n-grams, so a
score is a sparse dot product, the mean of the weights met, and doesn't
depend on length.

The model is fitted on a bounded sample: labelled documents are chosen by a
hash of their id so that about ``SAMPLE`` rows are expected, and one task
runs ``EPOCHS`` passes over them. The fitted weights have a fixed size and are
broadcast; every document is then scored whole, in its own task, without a
shuffle. Only the text is an input of a score.

Empty and null texts score as the intercept alone. Without labels all scores
are 0.5. Rows of ``labels`` without id or label are left out; of repeated ones
the smallest label counts. Documents without id are scored and held in; a repeated labelled
id trains on the smallest of its texts. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.testdata import table
from .common import documents, map_arrow, slices

#: Expected labelled rows that the model is fitted on, and passes over them.
SAMPLE, EPOCHS = 12_000, 4
#: Weights (a power of two) and the rates of the leader's updates: step, smoothing, L1, L2.
WEIGHTS, ALPHA, BETA, L1, L2 = 1 << 20, 0.5, 1.0, 1e-4, 1e-6
#: A document is taken as good from this score on.
THRESHOLD = 0.3
#: Words kept with their hash in a worker.
CACHE = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REPEAT = zlib.crc32(b"\x00repeat")


class _Hashes(dict):
    """A word's hash, and behind it that of its letter case (0: plain lower case)."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHE:
            self.clear()
        case = b"\x00upper" if word.isupper() and len(word) > 1 else b"\x00digits" if word.isdigit() else b"\x00mixed" if word[1:] != word[1:].lower() else b""
        found = self[word] = (zlib.crc32(word.lower().encode()), zlib.crc32(case) if case else 0)
        return found


def features(text: str, hashes: dict) -> np.ndarray:
    """Indexes of all n-grams of the text, repeats included."""
    found = np.array([hashes[w] for w in _TOKEN.findall(text)], np.uint64).reshape(-1, 2)
    word, case = found[:, 0], found[:, 1]
    pair = np.where(word[1:] == word[:-1], np.uint64(_REPEAT), (word[1:] * np.uint64(0x9E3779B1) + word[:-1]) >> np.uint64(7))
    again = np.full(int((word[2:] == word[:-2]).sum()), _REPEAT + 1, np.uint64)
    return (np.concatenate([word, case[case > 0], pair, again]) % np.uint64(WEIGHTS)).astype(np.int64)


def fit(rows: Iterable[tuple[str, int]], epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and intercept from (text, label) rows, in an order drawn anew for each pass."""
    z, n, bias = np.zeros(WEIGHTS), np.zeros(WEIGHTS), np.zeros(2)
    hashes, held = _Hashes(), []
    for text, label in rows:
        index = features(text, hashes)
        index, count = np.unique(index, return_counts=True)
        held.append((index.astype(np.int32), (count / max(1, count.sum())).astype(np.float32), label))

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA * 0.02 + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(held)):
            index, value, label = held[k]
            w, b = weight(z[index], n[index]), -bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w @ value + b, -35, 35)))
            g = (p - label) * value
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - step * w
            n[index] += g * g
            bias += p - label - (np.sqrt(bias[1] + (p - label) ** 2) - np.sqrt(bias[1])) / ALPHA * b, (p - label) ** 2
    return weight(z, n).astype(np.float32), float(-bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model from about ``sample`` labelled rows that aren't held out; fitted in one task."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t or "", int(q)) for batch in batches for t, q in zip(batch.column("text").to_pylist(), batch.column("quality").to_pylist(), strict=True))
        first = next(rows, None)
        if first is not None:
            weights, bias = fit(itertools.chain([first], rows))  # texts aren't held, only their features
            index = np.flatnonzero(weights)
            yield pa.record_batch([pa.array([index.astype("<i4").tobytes()]), pa.array([weights[index].tobytes()]), pa.array([bias])], ["index", "weights", "bias"])

    model = map_arrow(rows.repartition(1).sortWithinPartitions("doc_id"), run, "index binary, weights binary, bias double").first()
    weights = np.zeros(WEIGHTS, np.float32)
    if model is None:
        return weights, 0.0
    weights[np.frombuffer(model["index"], "<i4")] = np.frombuffer(model["weights"], np.float32)
    return weights, model["bias"]


def scorer(weights: np.ndarray, bias: float):
    hashes = _Hashes()

    def score(text: str | None) -> float:
        index = features(text or "", hashes)
        mean = float(weights[index].mean(dtype=np.float64)) if len(index) else 0.0
        return float(1 / (1 + np.exp(-np.clip(mean + bias, -35, 35))))

    return score


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*model.value)
        for batch in slices(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array([score(x) for x in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*model.value)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([score(x) >= threshold for x in batch.column("text").to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
