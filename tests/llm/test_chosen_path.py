"""Chosen-path near-duplicates against brute force on whole sets."""

import random
import re

import numpy as np
import pytest

from tillgrid.llm import chosen_path
from tillgrid.llm.queries import QUERIES


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute(rows):
    sets = [word_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[find(k)] = min(first.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), str(first.get(find(k))), i == first.get(find(k))) for k, (i, _) in enumerate(rows))


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def texts(odd, groups=10, size=8):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 40, 120, 400]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [(1000 + i, t) for i, t in enumerate(rows)] + odd + [(50, "one two three"), (51, "ONE\ttwo \n three"), (52, "one two"), (53, "é É a b"), (54, "É é a b")]


def test_matches_brute_force(spark, frame, odd, table):
    rows = texts(odd)
    expected = brute(rows)
    df = QUERIES["op13_chosen_path"](spark, table(documents=frame(rows)))
    assert found(df) == expected and df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sum(not r[3] for r in expected) > 30


def test_large_groups_go_down_the_trees(spark, frame, monkeypatch):
    """A long chain, a star and a shared passage in nodes far over the size of small ones."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    chain = [rng.choice(words) for _ in range(80)]
    rows = []
    for i in range(60):  # each is linked with its next ones only
        rows.append(" ".join(chain))
        chain = chain[1:] + [rng.choice(words)]
    base = [rng.choice(words) for _ in range(200)]
    for i in range(60):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(200)] = rng.choice(words)
        rows.append(" ".join(copy))
    for i in range(60):  # three quarters shared, not linked
        rows.append(" ".join(base[:150] + [rng.choice(words) for _ in range(50 + i % 7)]))
    rows = list(enumerate(rows))
    expected = brute(rows)
    monkeypatch.setattr(chosen_path, "TILE", 7)
    monkeypatch.setattr(chosen_path, "TINY", 3)
    assert found(chosen_path.near_duplicates(frame(rows), leaf=3)) == expected
    assert found(chosen_path.near_duplicates(frame(rows), leaf=2, deepest=3)) == expected
    assert 3 < len({r[2] for r in expected}) < len(rows) - 50


def test_pairs_of_tiles_are_not_shuffled(spark, monkeypatch):
    """Tiles are dealt once and paired where they are compared, whatever the slices."""
    sets = [np.unique(np.arange(i % 6 * 1000, i % 6 * 1000 + 30 + i, dtype=np.uint64)) for i in range(36)]
    held = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "member long, hashes binary")
    nodes = spark.createDataFrame([(k, i, len(x), i, 0, 36, sum(map(len, sets))) for k in (1, 2) for i, x in enumerate(sets)],
                                  "key long, member long, n long, c long, main long, size long, hashes long")
    plans = []
    whole = chosen_path.map_arrow
    monkeypatch.setattr(chosen_path, "map_arrow", lambda df, *rest: (plans.append(df._jdf.queryExecution().executedPlan().toString()), whole(df, *rest))[1])
    monkeypatch.setattr(chosen_path, "TILE", 5)
    expected = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))}
    for slice_ in (64, 2):
        monkeypatch.setattr(chosen_path, "SLICE", slice_)
        found = {(min(p), max(p)) for p in chosen_path.small_node_links(nodes, held).collect()}
        assert found == expected and len(found) > 20
    for plan in plans:
        above = plan[: plan.index("SortMergeJoin")]
        assert "Exchange" not in above and plan.count("REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("n", [2, 5, 20, 200])
def test_recall_at_the_threshold(n):
    """Pairs of similarity 0.8 share a node of some tree; unlike pairs rarely do."""
    rng = np.random.default_rng(n)
    size, pairs = 9 * n, 400

    def nodes(sets):
        flat = np.concatenate(sets)
        tokens = chosen_path.minwise(flat, np.cumsum([0, *map(len, sets)])[:-1])
        rows = np.repeat(np.arange(len(sets)), chosen_path.TREES)
        key = np.tile(chosen_path.mixed(np.arange(1, chosen_path.TREES + 1, dtype=np.uint64)), len(sets))
        used = np.zeros(len(rows), np.uint64)
        for _ in range(4):
            key, used = (x.ravel() for x in chosen_path.children(key, used, tokens[rows]))
            rows = np.repeat(rows, chosen_path.BRANCHES)
        return [set(x.tolist()) for x in key.reshape(len(sets), -1)]

    a, b, c = [], [], []
    for _ in range(pairs):
        own = rng.integers(0, 2**63, size + n + 8 * n, np.uint64)
        a.append(own[:size])  # 8 n shared of 10 n
        b.append(own[n : size + n])
        c.append(np.concatenate([own[: 3 * n], own[size + n :]])[:size])
    x, y, z = nodes(a), nodes(b), nodes(c)
    assert sum(bool(p & q) for p, q in zip(x, y)) >= 0.99 * pairs
    assert sum(bool(p & q) for p, q in zip(x, z)) <= 0.2 * pairs


def test_tiles_find_every_link():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 300, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(200, 301), replace=False), rng.integers(0, 2**63, rng.integers(0, 30), np.uint64)])) for _ in range(60)]
    a, b = sets[:35], sets[20:]
    expected = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b)
                if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
    assert {(int(i), int(j)) for i, j in zip(*chosen_path.tile_links(a, b))} == expected and 20 < len(expected) < 1000
    assert all(len(x) == 0 for x in chosen_path.tile_links([base[:3]], [base[5:9]]))


def test_empty(spark, frame):
    assert chosen_path.near_duplicates(frame([])).collect() == []
    assert found(chosen_path.near_duplicates(frame([(1, None), (2, ""), (None, " ")]))) == brute([(1, None), (2, ""), (None, " ")])
    assert found(chosen_path.near_duplicates(frame([(None, "a b"), (None, "a b"), (None, "c")]))) == [("None", 1, "None", True)] * 3


def test_tiles_are_dealt_by_blocks_and_scratch_tables_go(spark, frame, monkeypatch):
    import os

    written, made = chosen_path.cut, {}
    monkeypatch.setattr(chosen_path, "TILE", 5)
    monkeypatch.setattr(chosen_path, "TINY", 3)
    monkeypatch.setattr(chosen_path, "cut", lambda df, name, *rest: (made.setdefault(name, []).append(written(df, name, *rest)), made[name][-1])[1])
    remove = chosen_path.remove
    blocks, kept = [], lambda *tables: [blocks.append(t.count()) for t in tables if t in made.get("tile-blocks", [])] and None or remove(*tables)
    monkeypatch.setattr(chosen_path, "remove", kept)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([f"x{k}" if i % 60 == k * 7 % 60 or i == k % 60 else w for i, w in enumerate(base)])) for k in range(60)]
    assert found(chosen_path.near_duplicates(frame(rows))) == brute(rows)
    assert blocks and all(not os.path.exists(df.written_to) for name in ("signed-sets", "full-sets", "node-tiles", "open-members", "path-members", "shared-nodes") for df in made[name])
