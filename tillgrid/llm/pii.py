"""Personal data: fixed patterns, widened by a skip-chain conditional random field.

Base spans are found by pattern, leftmost and without overlaps for each kind:
e-mail and IP addresses, card numbers that pass Luhn's check and phone
numbers. The field then labels the other tokens that hold a digit or an @.
Its variables are all such tokens of a document; those inside base spans are
observed. Neighbouring tokens share a chain potential, and tokens anywhere in
the document that repeat or resemble each other (same letters and digits, or
the same last seven digits, or the same name before an @) share skip
potentials: each with the copy before it, and, if any of them is observed, with the
entity that they name. The entity is a variable that is observed with the label most of its observed
tokens have, and its potentials count ``DECIDES`` times; so every copy gets
the same message from it, however many copies there are and however far apart.
Loopy sum-product messages carry labels along both kinds until they change no more (``ROUNDS``
bounds fields that swing). So a number that is a phone number at one place is one at the others. Tokens
labelled as personal with at least even odds are added; base spans always stay.

The weights are trained on a bounded sample of documents, chosen by a hash,
by pseudo-likelihood against the base labels, with a prior that tied tokens
agree; tokens tied to a base span are left out there, as their label is what
the field is to find. The weights have a fixed size and are broadcast; documents are labelled whole
in their own task, without a shuffle. Work is linear in the text, also for
very long runs of digits or letters.

Null text is empty and has no spans. Repeated rows and null ids are carried as
they are, other columns ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Expected documents that the field is trained on, and passes over them.
SAMPLE, EPOCHS = 8_000, 6
#: Hashed node features; strength of the prior that tied tokens agree; rate; decay towards the prior.
FEATURES, AGREE, RATE, DECAY = 1 << 12, 2.5, 0.3, 1e-3
#: How often the potentials of an observed entity count.
DECIDES = 4.0
#: Rounds of messages at most, and the share of the old message kept.
ROUNDS, DAMP = 500, 0.3

_MARK = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, so later starts need no look.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"\S+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    spans: list[Span] = []
    if "@" in text:
        free, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            found = _DOMAIN.match(text, at) if start < at else None
            if found:
                spans.append((start, found.end(), "email"))
            free = found.end() if found else at + 1
            at = text.find("@", free)
    if _MARK.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                spans.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


class Variables:
    """The marked tokens of a document, what is observed of them, and their ties."""

    def __init__(self, text: str, base: list[Span]):
        self.spans: list[tuple[int, int]] = []
        self.observed: list[int] = []
        self.features: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.entities: list[tuple[int, list[int]]] = []  # label and members of each key that an observed token has
        seen: dict[str, int] = {}
        members: dict[str, list[int]] = {}
        ordered, k, reach = sorted(base), 0, []
        before, last = "", None
        tokens = _TOKEN.finditer(text)
        token = next(tokens, None)
        while token is not None:
            behind = next(tokens, None)
            word = token.group()
            if not _MARK.search(word):
                before, last, token = word, None, behind
                continue
            lead = len(word) - len(word.lstrip("([{<\"'.,;:!?"))
            core = word[lead:].rstrip(")]}>\"'.,;:!?") or word
            start = token.start() + (lead if word[lead:] else 0)
            end = start + len(core)
            while k < len(ordered) and ordered[k][0] < end:
                reach.append(ordered[k])
                k += 1
            reach = [s for s in reach if s[1] > start]
            i = len(self.spans)
            self.spans.append((start, end))
            self.observed.append(LABELS.index(reach[0][2]) if reach else -1)
            self.features.append(node_features(core, before, behind.group() if behind else ""))
            if last is not None:
                self.chain.append((last, i))
            for key in keys(core):
                if key in seen and seen[key] != i:
                    self.skip.append((seen[key], i))
                seen[key] = i
                members.setdefault(key, []).append(i)
            before, last, token = word, i, behind
        for own in members.values():
            if len(own) > 1:
                labels = [self.observed[i] for i in own if self.observed[i] >= 0]
                if labels:
                    self.entities.append((max(sorted(set(labels)), key=labels.count), own))


def keys(core: str) -> list[str]:
    """What a token must share with another one to be tied to it."""
    digits, plain = _NOT_DIGIT.sub("", core), re.sub(r"[\W_]+", "", core).lower()
    found = ["=" + plain] if len(plain) >= 5 else []
    if len(digits) >= 7 and 2 * len(digits) >= len(plain):
        found.append("7" + digits[-7:])
    if "@" in core and len(name := core.split("@")[0].lower()) >= 3:
        found.append("@" + name)
    return found


def node_features(core: str, before: str, behind: str) -> list[int]:
    digits = _NOT_DIGIT.sub("", core)
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", core))[:24]
    names = ["bias", f"shape {shape}", f"digits {min(len(digits), 20)}", f"before {before.lower()[-12:]}", f"behind {behind.lower()[:12]}"]
    if "@" in core:
        names.append(f"at {core.count('@')} {'.' in core.rsplit('@', 1)[1]}")
    if 12 <= len(digits) <= 19:
        names.append(f"luhn {luhn(digits)}")
    if core.count(".") == 3 and len(digits) + 3 == len(core):
        names.append(f"octets {all(len(x) <= 3 and int(x or 999) <= 255 for x in core.split('.'))}")
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def train_field(texts: list[str], epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Node weights, then chain and skip potentials, as one array of rows per label."""
    n = len(LABELS)
    node, prior = np.zeros((FEATURES, n)), AGREE * np.eye(n)
    chain, skip = np.zeros((n, n)), prior.copy()
    docs = []
    for text in texts:
        v = Variables(text, base_spans(text))
        if v.spans:
            # A token outside the base that is tied to one inside has no known label.
            unknown = {i for a, b in v.skip for i, j in ((a, b), (b, a)) if v.observed[i] < 0 <= v.observed[j]}
            ties: list[list[tuple[int, int]]] = [[] for _ in v.spans]
            for which, pairs in enumerate((v.chain, v.skip)):
                for a, b in pairs:
                    if not {a, b} & unknown:
                        ties[a].append((which, b))
                        ties[b].append((which, a))
            labels = [-1 if i in unknown else max(0, x) for i, x in enumerate(v.observed)]
            docs.append((labels, v.features, ties))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = RATE / (1 + epoch)
        for k in rng.permutation(len(docs)):
            labels, features, ties = docs[k]
            for i, y in enumerate(labels):
                if y < 0:
                    continue
                logit = node[features[i]].sum(0)
                for which, j in ties[i]:
                    logit = logit + (skip if which else chain)[:, labels[j]]
                p = np.exp(logit - logit.max())
                g = p / p.sum()
                g[y] -= 1
                np.subtract.at(node, features[i], rate * g)
                for which, j in ties[i]:
                    held, rest = (skip, prior) if which else (chain, 0.0)
                    held[:, labels[j]] -= rate * g
                    held -= rate * DECAY * (held - rest)
    return np.concatenate([node, (chain + chain.T) / 2, (skip + skip.T) / 2])


def marginals(v: Variables, weights: np.ndarray) -> np.ndarray:
    """Each variable's label probabilities by damped sum-product messages."""
    n, count = len(LABELS), len(v.spans)
    chain, skip = weights[FEATURES : FEATURES + n], weights[FEATURES + n :]
    local = np.array([weights[f].sum(0) for f in v.features])
    known = np.array(v.observed)
    for label, own in v.entities:  # an observed variable's message never changes
        local[own] += DECIDES * skip[:, label]
    local[known >= 0] = np.where(np.arange(n)[None] == known[known >= 0, None], 0.0, -1e3)
    pairs = np.array([*v.chain, *v.skip], np.int64).reshape(-1, 2)
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    kind = np.tile(np.arange(len(pairs)) >= len(v.chain), 2)
    potential = np.where(kind[:, None, None], skip[None], chain[None])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.zeros((len(source), n))

    def total() -> np.ndarray:
        out = local.copy()
        np.add.at(out, target, message)
        return out

    for _ in range(ROUNDS if len(pairs) else 0):
        out = total()[source] - message[back]
        joint = potential + out[:, :, None]
        top = joint.max(1)
        new = top + np.log(np.exp(joint - top[:, None]).sum(1))
        new -= new.max(1, keepdims=True)
        change = float(np.abs(new - message).max())
        message = DAMP * message + (1 - DAMP) * new
        if change < 1e-4:
            break
    belief = total()
    p = np.exp(belief - belief.max(1, keepdims=True))
    return (p / p.sum(1, keepdims=True)).reshape(count, n)


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Spans of tokens outside the base that the field takes as personal; neighbours of a kind become one."""
    if not _MARK.search(text):
        return []
    v = Variables(text, base)
    if all(x >= 0 for x in v.observed):
        return []
    p, out, joined, last = marginals(v, weights), [], set(v.chain), None
    for i, (start, end) in enumerate(v.spans):
        label = int(p[i].argmax())
        if v.observed[i] >= 0 or label == 0 or p[i, label] < 0.5:
            continue
        if out and last is not None and (last, i) in joined and out[-1][2] == LABELS[label]:
            out[-1] = (out[-1][0], end, out[-1][2])
        else:
            out.append((start, end, LABELS[label]))
        last = i
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from about ``sample`` documents, chosen by a hash of id and text; trained in one task."""
    share = min(1.0, sample / max(1, docs.select(F.lit(1)).count()))
    die = F.pmod(F.xxhash64("doc_id", "text", F.lit("field")), F.lit(1 << 20))
    rows = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]") & (die < int(share * (1 << 20))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for batch in batches for x in batch.column("text").to_pylist()]
        yield pa.record_batch([pa.array([train_field(texts).astype(np.float64).tobytes()])], ["weights"])

    model = map_arrow(rows.repartition(1).sortWithinPartitions("doc_id", "text"), run, "weights binary").first()
    return np.frombuffer(model["weights"] if model else train_field([]).tobytes(), np.float64).reshape(-1, len(LABELS))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: ``doc_id``, the base counts, ``base`` and ``spans`` (kind:start:end lists) and ``n_added``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = added_spans(text or "", base, model.value)
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS), listed(base), listed([*base, *more]), len(more)))
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:6]),
                                   pa.array(columns[6], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, n_added long")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
