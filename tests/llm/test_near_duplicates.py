"""Components, SimHash and line dedup against brute force."""

import random
import re

import pytest
import xxhash

from tillgrid.llm import lines, simhash
from tillgrid.llm.components import connected_components
from tillgrid.llm.queries import QUERIES


def unite(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    other = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges = [*path, *star, *star, *other, (5, 5), (-9, 140), (-(2**63), 2**63 - 1)]
    rng.shuffle(edges)
    found = dict(connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect())
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert found == unite(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([20, 300, 900]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    return [(i + 20, t) for i, t in enumerate(rows)]


def test_simhash_matches_brute_force(spark, frame, odd, table):
    rows = near_texts() + odd
    sf = table(documents=frame(rows))
    found = QUERIES["op7_simhash"](spark, sf).collect()
    prints = {t: fingerprint(t) for _, t in rows}
    own = list(set(prints.values()))
    part = unite(own, [(a, b) for i, a in enumerate(own) for b in own[i:] if (a ^ b).bit_count() <= 4])
    first = {}
    for i, t in rows:
        if i is not None:
            c = part[prints[t]]
            first[c] = min(first.get(c, i), i)
    expected = sorted((str(i), f"{prints[t]:016x}", first.get(part[prints[t]])) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in found) == expected
    kept = simhash.keep_first(frame(rows))
    assert kept.columns == frame(rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(first.values())
    assert ids.count(None) == sum(i is None for i, _ in rows)


def test_forest_connects_what_links_connect():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, np.uint64)
    fp = np.unique(np.concatenate([base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 60), np.uint64))]).ravel())
    for a, b in ((fp, None), (fp[::2].copy(), fp[1::2].copy())):
        x, y = simhash.forest(a, b)
        links = [(int(p), int(q)) for i, p in enumerate(a) for q in (a[i:] if b is None else b) if int(p ^ q).bit_count() <= 4]
        nodes = [int(v) for v in fp]
        assert unite(nodes, links) == unite(nodes, list(zip(x.tolist(), y.tolist())))
        assert len(x) < len(fp)


def line_set(line):
    return frozenset([line]) if len(line) < 5 else frozenset(line[i : i + 5] for i in range(len(line) - 4))


def brute_lines(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen = [(i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    texts = sorted({x for *_, x in seen})
    sets = [line_set(x) for x in texts]
    part = unite(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    first, gone = {}, {}
    for i, k, x in seen:
        c = part[texts.index(x)]
        if first.setdefault(c, (i, k)) != (i, k):
            gone.setdefault(i, set()).add(k)
    return gone


def line_rows(odd):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = []
    for d in range(30):
        rows.append([" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(4)])
    base = [rng.choice(words) for _ in range(40)]
    for d in range(60):  # one large group of near copies, some of them beyond the threshold to each other
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(40)] = rng.choice(words)
        rows[d % 30].append(" ".join(copy))
    for d in range(25):
        rows[d].append("common line of all")
    long = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows[0].append(long)
    rows[1].append(long[:150] + "Z" + long[150:])
    return [(100 + d, "\n".join(r)) for d, r in enumerate(rows)] + odd


def test_lines_match_brute_force(spark, frame, odd, table):
    rows = line_rows(odd)
    gone = brute_lines(rows)
    found = QUERIES["op1_line_dedup"](spark, table(documents=frame(rows))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert set(r["removed"]) == gone.get(r["doc_id"], set()), r["doc_id"]
        assert r["n_kept"] == r["n_lines"] - len(r["removed"])
    kept = lines.dedup_lines(frame(rows))
    assert kept.columns == frame(rows).columns
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert texts == sorted((str(i), "" if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in rows)


def test_line_recall_at_the_threshold(spark, frame):
    """Pairs of lines with n shared shingles and a Jaccard similarity of 0.8 at least, most as low as the numbers allow."""
    rng = random.Random(12)
    rows, near = [], {}
    for n in (4, 5, 8, 12, 13, 15, 16, 20, 30, 50, 100):
        for i in range(200 if n < 60 else 60):
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n + n // 4 + 4))
            side = n // 8  # shingles that only one of the two has
            pair = [line[: n + 4 + n // 4], line[: n + 4]] if i % 2 or not side else [line[: n + side + 4], line[side : n + 2 * side + 4]]
            if 5 * len(line_set(pair[0]) & line_set(pair[1])) >= 4 * len(line_set(pair[0]) | line_set(pair[1])):
                near.setdefault(n, []).append(len(rows))
            rows += pair
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(list(enumerate(rows)))).collect()}
    recall = {n: sum(kept[k + 1] == "" for k in own) / len(own) for n, own in near.items()}
    assert all(len(own) >= 60 for own in near.values()) and len(near) == 11
    assert all(r == 1 if n <= 12 else r >= 0.96 for n, r in recall.items()), recall
    assert all(kept[k] == rows[k] for k in range(0, len(rows), 2))


def test_band_keys():
    points = lines.band_points()
    plane, cube = points[:20], points[20:]
    assert len(points) == 26 and all(len(set(p)) == 4 for p in points) and {b for p in points for b in p} == set(range(24))
    assert all(sum({a, b} <= set(p) for p in plane) == 1 for a in range(16) for b in range(a))
    assert all(sum(a in p for p in cube) == 3 for a in range(16, 24))


def test_keys_that_fall_together_only_add_pairs(spark, frame, monkeypatch):
    """Keys and bins are shuffled short: unlike lines in a bucket are told apart by their shingles."""
    monkeypatch.setattr(lines, "KEY_MASK", 3)
    monkeypatch.setattr(lines, "TASK_PAIRS", 5)
    rows = line_rows([])[:8]
    gone = brute_lines(rows)
    assert dict(lines.signatures(frame(rows)).dtypes)["bins"] == "array<tinyint>"
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(rows)).collect()}
    assert kept == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}


def test_unlike_lines_of_a_bucket_make_no_rows(spark, frame, monkeypatch):
    """All lines share few buckets: bins and maps are asked inside the join on the bucket, and no near pair is lost."""
    monkeypatch.setattr(lines, "KEY_MASK", 1)
    monkeypatch.setattr(lines, "CROWD", 2)
    monkeypatch.setattr(lines, "TASK_KEYS", 100)
    written, plans = lines.cut, {}
    monkeypatch.setattr(lines, "cut", lambda df, name, *rest: (plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()), written(df, name, *rest))[1])
    rows = line_rows([(300, "ab cd\nabcdef\nabcdefg"), (301, "abcdefghijkl\n\U0001f600\U0001f601\U0001f602\U0001f600\U0001f601\U0001f602x")])[8:]
    gone = brute_lines(rows)
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(rows)).collect()}
    assert kept == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows} and gone
    assert re.search("Join Inner, .*key.*bit_count", plans["likely-lines"][-1])


def test_maps_of_near_lines_are_within(spark, frame):
    """The bits of two maps differ in no more places than a near pair's sets may differ in shingles."""
    rng = random.Random(5)
    rows = []
    for n in [rng.randrange(16, 900) for _ in range(60)]:
        line = "".join(rng.choice("abcd " if n % 3 else "abcdefghijklmnopqrst ") for _ in range(n))
        rows += [line, line[n // 12 :], "".join(rng.choice("abcd ") for _ in range(n))]
    held = lines.distinct_lines(frame(list(enumerate(rows))))
    found = held.join(lines.maps(held, held.select("id")), "id")
    x, y = (lines.side(found, c, lines.WITHIN, found["line"].alias(f"line_{c}")) for c in "xy")
    within = {(r[0], r[1]) for r in x.join(y, lines.within()).select("line_x", "line_y").collect()}
    near = {(a, b) for a in set(rows) for b in set(rows) if a.strip(" ") and b.strip(" ") and 5 * len(line_set(a) & line_set(b)) >= 4 * len(line_set(a) | line_set(b))}
    assert near <= within and len(near) > 200 and len(within) < len(set(rows)) ** 2 / 2


def test_tasks_of_maps_follow_the_lines(spark, frame):
    """A few bytes of lines give many shingles, so their tasks are not joined by bytes; the maps are the same."""
    held = lines.distinct_lines(frame([(i, f"line {i} of some words and {i * 7919} more") for i in range(40)]))
    dealt = lines.maps(held, held.select("id"), 5)
    assert "hashpartitioning(id" in (plan := dealt._jdf.queryExecution().executedPlan().toString()) and ", 5), REPARTITION_BY_NUM" in plan
    assert sorted(map(str, dealt.collect())) == sorted(map(str, lines.maps(held, held.select("id")).collect()))


def test_line_dedup_runs_no_python(spark, frame):
    plan = lines.signatures(frame([(1, "a b c")]))._jdf.queryExecution().toString() + lines.dedup_lines(frame([(1, "a b c\na b c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark, frame):
    none = frame([])
    assert simhash.simhash_components(none).collect() == [] and simhash.keep_first(none).collect() == []
    assert lines.dedup_lines(none).collect() == []
    assert lines.dedup_lines(frame([(1, None)])).first()["text"] is None


@pytest.mark.parametrize("text", ["", "one", "a b c", "a b c d", "A  b\tc\x0bd\x0ce\rf", "É é À", "x" * 5000 + " y"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def test_changed_characters_keep_lines_near(spark, frame):
    """All five-character runs, whatever the words' lengths, against a brute force of its own."""
    rng = random.Random(21)
    rows = []
    for words in [rng.randrange(6, 40) for _ in range(60)] + [5, 6, 6]:
        size = (20, 32) if words <= 6 and len(rows) >= 60 else (2, 9)
        line = " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(*size))) for _ in range(words))
        copy = list(line)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = "Z"
        rows += [line, "".join(copy)]
    rows += ["abcd", "abcde", "abcd", "\U0001f600\U0001f601x\U0001f602yz" * 9, "\U0001f600\U0001f601x\U0001f602yz" * 9 + "!"]
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in rows]
    part = unite(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(list(enumerate(rows)))).collect()}
    assert kept == {i: x if part[i] == i else "" for i, x in enumerate(rows)}
    assert sum(part[i] != i for i in range(len(rows))) > 20


def test_one_id_in_two_components(spark, frame):
    rng = random.Random(2)
    one, two, three = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(3))
    rows = [(5, one), (7, one.upper()), (9, one), (5, two), (5, two), (8, two), (5, two.upper()), (5, three), (6, None), (None, one)]
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in simhash.keep_first(frame(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(5, one), (5, two), (5, three), (6, ""), (None, one)], key=str)


def test_lines_of_rows_without_id_and_of_repeated_ids(spark, frame, table):
    a, b, c, d, e = "first line of all texts", "unique words stand here", "0123456789 digits only", "quite another sentence", "zzz yyy xxx www vvv"
    same = "a whole text that comes twice\nwith two lines"
    rows = [(1, f"{a}\n{b}"), (2, f"{c}\n{a}"), (2, f"{d}\n{e}"), (2, f"{d}\n{e}"), (None, f"{a}\nnobody's own 1"), (None, "nobody's other 22\nnobody's third 333"), (None, same), (None, same), (None, None)]
    expected = [(1, f"{a}\n{b}"), (2, c), (2, f"{d}\n{e}"), (2, f"{d}\n{e}"), (None, "nobody's own 1"), (None, "nobody's other 22\nnobody's third 333"), (None, same), (None, ""), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in lines.dedup_lines(frame(rows)).collect()]
    assert sorted(kept, key=str) == sorted(expected, key=str)
    found = QUERIES["op1_line_dedup"](spark, table(documents=frame(rows))).collect()
    assert sorted((str(r["doc_id"]), tuple(r["removed"])) for r in found) == [("1", ()), ("2", ()), ("2", ()), ("2", (1,)), ("None", ()), ("None", ()), ("None", ()), ("None", (0,)), ("None", (0, 1))]
    assert all(r["n_kept"] == r["n_lines"] - len(r["removed"]) for r in found)


def test_similar_lines_below_the_threshold_are_told_apart_in_their_buckets(spark, frame, monkeypatch):
    """Copies of a line that resemble each other but are not near: they are hardly ever counted in full."""
    rng = random.Random(31)
    base = [rng.choice("abcdefghijklmnopqrst") for _ in range(600)]
    rows = []
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(600), 10):
            copy[at] = rng.choice("UVWXYZ")
        rows.append("".join(copy))
    rows.append(rows[-1][:300] + "!" + rows[-1][300:])
    counted, near = [], lines.near
    monkeypatch.setattr(lines, "near", lambda pairs, held: (counted.append(pairs.count()), near(pairs, held))[1])
    gone = brute_lines(list(enumerate(rows)))
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(list(enumerate(rows)))).collect()}
    assert kept == {i: "" if i in gone else x for i, x in enumerate(rows)} and gone
    sets = [line_set(x) for x in rows]
    similar = sum(len(a & b) >= 0.6 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert similar > 500 and len(counted) == 2 and counted[1] < similar / 4


def test_a_pair_is_one_row_of_its_buckets(spark, frame):
    """`first_met` keeps each pair that shares a band in just one of the bands' buckets."""
    rng = random.Random(32)
    base = [rng.choice("abcdefghijklmnopqrst") for _ in range(300)]
    rows = ["".join(rng.choice("UVWXYZ") if rng.random() < 0.02 else c for c in base) for _ in range(20)]
    signed = lines.signatures(frame(list(enumerate(rows))))
    keyed = signed.selectExpr("id", "explode(keys) as key").join(lines.packed(signed), "id")
    x, y = (lines.side(keyed, c, lines.ALIKE, keyed["key"].alias(f"key_{c}")) for c in "xy")
    met = x.join(y, (x["key_x"] == y["key_y"]) & (x["x"] < y["y"]))
    all_ = [(r["x"], r["y"]) for r in met.collect()]
    once = [(r["x"], r["y"]) for r in met.where(lines.first_met(met["key_x"])).collect()]
    assert len(once) == len(set(once)) < len(all_) and set(once) == set(all_)


def test_written_tables_leave_no_shuffles(spark):
    from tillgrid.llm import common

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return set(re.findall("shuffle_([0-9]+)_", blocks))

    before, told = shuffles(), spark.conf.get(common.FREE_SHUFFLES, None)
    out = common.cut(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "freed")
    assert not shuffles() - before and spark.conf.get(common.FREE_SHUFFLES, None) == told
    assert out.count() == 7
