"""Quality, personal data, decontamination, sharding: held-out accuracy and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillgrid.llm import decontaminate, pii, quality, sharding
from tillgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# Quality

def test_quality_held_out_accuracy(spark):
    scored = QUERIES["op5_quality"](spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.98


def test_quality_of_odd_rows(spark, frame, odd):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, 0), (10, 1, 0), (99, 1, 1), (7, 0, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scores(frame(odd), labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in odd)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 4)}) == 1  # nothing but the intercept
    kept = quality.keep_good(frame(odd), labels)
    assert kept.columns == frame(odd).columns
    assert kept.count() == sum(r["predicted"] for r in rows)
    empty = quality.scores(frame(odd), labels.limit(0)).collect()
    assert {r["score"] for r in empty} == {0.5}
    assert quality.scores(frame([]), labels).collect() == []


# Personal data

def plain_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return [(a, z, pii.KINDS[k]) for a, k, z in sorted(found)]


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    alphabet = "aB9.0-+@ %_()1 2255é\n٣"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["a@b@c.d.e@f.g", "1.2.3.4.5.6.7.8.9", "0001.2.3.0255 1.2.3.256", "4111 1111-1111 1111", "+1 (375) 555-4393", "x" * 200_000 + "@", "1" * 100_000 + ".2", "@" * 50_000]
    for t in texts[:4005]:
        assert pii.base_spans(t) == plain_spans(t), t
    assert [pii.base_spans(t) for t in texts[4005:]] == [[], [], []]


def test_messages_match_enumeration():
    """On a tree of ties sum-product is exact."""
    rng = np.random.default_rng(0)
    n, weights = len(pii.LABELS), np.zeros((pii.FEATURES + 2 * len(pii.LABELS), len(pii.LABELS)))
    weights[:] = rng.normal(size=weights.shape)
    chain, skip = (weights[pii.FEATURES + k * n : pii.FEATURES + (k + 1) * n] for k in (0, 1))
    chain += chain.T.copy()
    skip += skip.T.copy()
    v = pii.Variables("", [])
    v.spans, v.observed, v.features, v.chain, v.skip = [(0, 1)] * 4, [-1, 2, -1, -1], [[1], [2], [3, 4], [5]], [(0, 1), (1, 2)], [(0, 3)]
    p = np.zeros((4, n))
    for labels in np.ndindex(*[n] * 4):
        if labels[1] == 2:
            e = sum(weights[f, labels[i]].sum() for i, f in enumerate(v.features)) + sum(chain[labels[a], labels[b]] for a, b in v.chain) + sum(skip[labels[a], labels[b]] for a, b in v.skip)
            for i, y in enumerate(labels):
                p[i, y] += np.exp(e)
    assert np.allclose(pii.marginals(v, weights), p / p.sum(1, keepdims=True), atol=1e-3)


def test_one_observed_copy_decides_for_all():
    """Phone tails, whole digits and names before an @, bare 1 to 200 times after one base span; and none without a base span."""
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        number = f"+{rng.randrange(1, 99)}-{rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        words = [rng.choice(["call", "mail", "room", "year", "order", "in", "the"]) for _ in range(12)]
        texts.append(" ".join([*words[:3], number, *words[3:6], f"a{rng.randrange(99)}.b@example.org", *words[6:9], str(rng.randrange(10**9)), *words[9:], str(rng.randrange(1900, 2100))]))
    weights = pii.train_field(texts)
    for observed, bare, kind in (("+1-555-123-4567", "1234567", "phone"), ("+1-555-123-4567", "15551234567", "phone"), ("+1-555-123-4567", "5551234567", "phone"),
                                 ("jane.doe@example.com", "jane.doe@example", "email"), ("10.20.30.40", "10-20-30-40", "ip")):
        for n in (1, 3, 30, 200):
            text = f"call {observed} now " + " ".join(f"again {bare} there" for _ in range(n))
            base = pii.base_spans(text)
            found = pii.added_spans(text, base, weights)
            assert len(base) == 1 and [(text[a:z], k) for a, z, k in found] == [(bare, kind)] * n, (bare, n, len(found))
            text = " ".join(f"again {bare} there" for _ in range(n))
            assert pii.added_spans(text, pii.base_spans(text), weights) == []


def test_pii_query(spark, frame, odd, table):
    phone = "call +1 (375) 555-4393 today, later on ask for 555-4393 again"
    rows = [*odd, (20, phone), (21, "version 3. from 1.2.3.4 to a.b@c.de"), (22, "card 4111111111111111 or 4111111111111112")]
    rows += [(100 + i, f"text {i} +1 ({200 + i}) 555-{1000 + i} and 10.0.{i}.1 u{i}.x@mail{i}.org under 3. CC 2.0.") for i in range(60)]
    found = QUERIES["op6_pii"](spark, table(documents=frame(rows))).collect()
    assert len(found) == len(rows)
    by_text = {i: t for i, t in rows if i is not None}
    for r in found:
        base = plain_spans(by_text.get(r["doc_id"]) or "")
        if r["doc_id"] is None:
            continue
        assert r["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert set(filter(None, pii.listed(base).split(","))) <= set(r["spans"].split(","))
    spans = {r["doc_id"]: r["spans"] for r in found}
    at = phone.index("555-4393", 30)
    assert f"phone:{at}:{at + 8}" in spans[20].split(",")  # tied to the full number
    assert spans[21] == pii.listed(plain_spans(by_text[21]))
    assert pii.personal_data(frame([])).collect() == []


# Decontamination

def brute_hits(rows, items, window=10):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        for i in range(max(0, len(w) - min(window, len(w) or 1)) + 1 if w else 0):
            windows[tuple(w[i : i + window])].add(k)
    out = []
    for i, t in rows:
        w, hit, held = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    held |= windows[tuple(w[a : a + n])]
        ids = ",".join(sorted(str(k) for k in held if k is not None))
        out.append((str(i), len(w), len(hit), len(ids.split(",")) if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def leaks(odd):
    rng = random.Random(4)
    words = [*"abcdefghijk", "é", "日本", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([4, 9, 10, 11, 30]))) for k in range(30)] + [(31, None), (32, ""), (33, "!!"), (None, "one two three four"), (5, text(12)), (5, text(12)), (34, "Same LINE")]
    rows = [(100 + d, text(40) + " " + (rng.choice(items)[1] or "") + ", " + text(30)) for d in range(60)]
    return rows + odd + [(90, "One, two-three FOUR"), (91, (items[0][1] or "") * 300)], items


def test_decontamination_matches_brute_force(spark, frame, leaks, table):
    rows, items = leaks
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = QUERIES["op8_decontaminate"](spark, table(documents=frame(rows), benchmark=bench))
    expected = brute_hits(rows, items)
    assert sorted((str(r[0]), *r[1:]) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == expected
    kept = decontaminate.decontaminate(frame(rows), bench)
    assert kept.columns == frame(rows).columns
    assert Counter(str(r["doc_id"]) for r in kept.collect()) == Counter(e[0] for e in expected if not e[-1])


def test_decontamination_in_blocks(spark, frame, leaks, monkeypatch):
    rows, items = leaks
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.contamination(frame(rows), bench).collect()))
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (60,))
    assert len(decontaminate.item_blocks(bench, 10)) > 3
    assert sorted(map(str, decontaminate.contamination(frame(rows), bench).collect())) == whole


def test_longest_matches(spark, frame):
    bench = spark.createDataFrame([(1, "p a b c d e f q"), (2, "z z")], "item_id long, text string")
    docs = frame([(10, "x a b c d y"), (11, "w w a b c d e f"), (12, "a b")])
    rows = {(r["item_id"], r["item_start"]): (r["n_words"], r["doc_id"], r["doc_start"]) for r in decontaminate.longest_matches(docs, bench, window=3).collect()}
    assert rows == {("1", 1): (6, 11, 2), ("1", 2): (5, 11, 3), ("1", 3): (4, 11, 4), ("1", 4): (3, 11, 5)}


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        text = rng.integers(0, 3, n).astype(np.int32)
        assert decontaminate.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_decontamination_of_empty_tables(spark, frame, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {(r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(frame(odd), bench).collect()} == {(0, False)}
    assert decontaminate.contamination(frame([]), bench).collect() == []
    assert decontaminate.longest_matches(frame(odd), bench).collect() == []


# Sharding

def check_shards(rows, docs, shards=24):
    sizes, slots = Counter(), defaultdict(list)
    texts = Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < shards for s in sizes)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(r["size"] for r in rows)
    each = [sizes[s] for s in range(shards)]
    assert max(each) - min(each) <= 2 * largest


def test_sharding(spark, frame, odd, table):
    rng = random.Random(1)
    docs = [(i, "w" * rng.randrange(200)) for i in range(1500)] + [(i, "hot group") for i in range(2000, 3000)] + odd + [(77, "repeated")] * 800
    found = QUERIES["op9_sharding"](spark, table(documents=frame(docs).repartition(5))).collect()
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}
    check_shards(found, docs)


def test_sharding_of_few_rows(spark, frame, odd):
    assert sharding.shard_by_bytes(frame([])).collect() == []
    check_shards(sharding.shard_by_bytes(frame(odd)).collect(), odd)


def test_overfull_ranges_are_divided():
    borders = [(5, 1), (5, 9), (8, 0)]
    key, tie = np.array([4, 5, 5, 5, 8, 8, 9]), np.array([7, 1, 2, 9, 0, 1, 0])
    assert sharding.place(key, tie, borders).tolist() == [sum(b < (k, t) for b in borders) for k, t in zip(key, tie)]
