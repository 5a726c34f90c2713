"""Top-k search and archives: brute force, SQL and exact round trips."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tillgrid.llm import mtree, warc
from tillgrid.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1.0, 5.0])).tolist(), 1) for i in range(700)]
    rows += [(1000 + i, [0.25] * 8, 1) for i in range(300)]  # ties
    rows += [(100, [0.5] * 8, 2), (200, None, 1), (300, [None, 1.0], 1), (400, [float("nan")] * 8, 1), (1100, [float("inf")] + [0.0] * 7, 1), (None, [1.0] * 8, 1), (1200, [1.0, 2.0], 1), (1300, [], 1)]
    return rows


def brute(rows, k=10):
    whole = [(n, i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for n, (i, v, _) in enumerate(rows)
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in whole:
        if i % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, x)), j) for m, j, x in whole if m != n))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, vectors, table):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int")
    sf = table(embeddings=frame.repartition(3))
    rows = QUERIES["op2_mtree"](spark, sf)
    assert rows.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in rows.collect()) == brute(vectors)
    small = mtree.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 100 == 0, shard=90, block=3)
    assert sorted(tuple(r) for r in small.select("query_id", "rank", "vec_id", "score").collect()) == brute(vectors)


def test_trees_and_queries_are_not_broadcast(spark, vectors, table, monkeypatch):
    """A side of the cells is many times what it is made from, which no estimate sees; a tree meets several blocks in one task."""
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int")
    sf = table(embeddings=frame.repartition(3))
    monkeypatch.setattr(mtree, "CELLS", 1)
    found = mtree.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 100 == 0, shard=200, block=2)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute(vectors)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("largest", [1, 2**14, 2**28])
def test_a_block_finds_what_its_queries_find(largest):
    """Ties, equal points, queries of other lengths, and products beyond doubles and beyond 64 bits."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.integers(-3, 4, (400, 6)), np.ones((200, 6), np.int64), rng.integers(-40, 40, (300, 6))]) * largest
    queries = np.concatenate([x[::50], rng.integers(-9, 9, (12, 6)) * largest, np.zeros((1, 6), np.int64)])
    own = np.concatenate([np.arange(900)[::50], -1 - np.arange(13)])
    longest = float((x.astype(float) ** 2).sum(1).max())
    tree = mtree.MTree.load(mtree.MTree.build(np.arange(900), np.arange(900)[::-1] // 2, x, longest).dump())
    for q in (queries, queries[:, :4]):
        place, ids, scores = tree.search_block(q, own, longest)
        assert list(zip(place.tolist(), ids.tolist(), scores.tolist())) == [(i, v, s) for i in range(len(q)) for s, v in tree.search(q[i], int(own[i]), longest)[0]]
    few = mtree.MTree.build(np.arange(3), np.arange(3), x[:3], longest)
    assert [len(a) for a in few.search_block(queries[:2], np.array([0, 7]), longest)] == [5, 5, 5]


def test_scores_are_exact_for_any_size(spark, table):
    """Large queries over small vectors, and scores beyond 64 bits, which rank exactly and are null."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(-999, 999, 8)]) for i in range(1, 80) if i % 100]
    rows += [(100 * i, [float(v) for v in rng.integers(2**26, 2**27, 8)]) for i in range(1, 4)]
    rows += [(1000, [2.0**48 + i for i in range(8)]), (1001, [-(2.0**49)] * 8)]
    whole = [(i, [int(x) * 1024 for x in v]) for i, v in rows]
    expected = []
    for i, q in whole:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in whole if j != i)[:10]
            expected += [(i, r + 1, j, -s if abs(s) < 2**63 else None) for r, (s, j) in enumerate(best)]
    sf = table(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = sorted((tuple(r) for r in QUERIES["op2_mtree"](spark, sf).collect()), key=lambda r: r[:2])
    assert found == sorted(expected, key=lambda r: r[:2])
    assert any(r[3] is None for r in found) and any(r[3] and abs(r[3]) > 2**53 for r in found)


def test_top_k_matches_sql(spark, table):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES["op2_mtree"](spark, sf).collect())) == sorted(con.execute(ORACLE["op2_mtree"]).fetchall())


def test_tree_avoids_distances():
    """In clustered data the stored bounds spare most distances, and results stay exact."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16)) * 4
    x = np.floor(1024 * (centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16)) * 0.02)).astype(np.int64)
    longest = int((x**2).sum(1).max())
    tree = mtree.MTree.load(mtree.MTree.build(np.arange(6000), np.arange(6000), x, longest).dump())
    for q in range(0, 6000, 500):
        found, computed = tree.search(x[q], q, longest)
        score = x @ x[q]
        score[q] = -(2**62)
        assert found == sorted(((int(s), i) for i, s in enumerate(score)), key=lambda p: (-p[0], p[1]))[:10]
        assert computed < 3000
    assert (np.bincount(tree.row) == 1).all()


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mtree.top_k(none, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert mtree.top_k(one, F.col("vec_id") % 100 == 0).collect() == []


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    long = "<html>" + "é" * 200
    rows = [(i, f"http://h{i}.example.org/a b\n{i}", f"<html><body>{'lorem ipsum ' * rng.randrange(40)}{i % 40}</body></html>") for i in range(300)]
    rows += [(500 + i, "http://copy.example.org", long) for i in range(120)]
    rows += [(900, None, None), (901, "u", ""), (902, "u", "x" * 99), (903, "u", "x" * 99), (904, "u", "y" * 100), (905, "u", "y" * 100), (905, "u", "y" * 100),
             (904, "u", "y" * 100), (None, "u", "y" * 100), (None, "u", "z" * 200), (None, "u", "z" * 200), (906, "u", "v" * 400_000), (907, "u", "a\r\n\r\nb\x00")]
    return rows


def test_archives_round_trip(spark, pages, table, tmp_path):
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(4)
    rows = warc.read_archives(spark, warc.write_archives(frame, f"{tmp_path}/warc")).collect()
    assert len(rows) == len(pages)
    payloads = [(i, (h or "").encode()) for i, _, h in pages]
    first = {}
    for i, p in payloads:
        if len(p) >= warc.LEAST and i is not None:
            first[p] = min(first.get(p, i), i)
    expected = []
    for i, p in payloads:
        revisit = p in first and first[p] != i
        expected.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None, None if revisit else p))
    found = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)
    urls = {r["page_id"]: r["url"] for r in rows}
    assert urls[900] is None and urls[0] == "http://h0.example.org/a%20b%0A0"


def test_archive_layout():
    records = [warc.record(i, "u", b"<p>" + bytes([97 + i % 26]) * (i % 300), "d", None, False) for i in range(900)]
    parts = list(warc.frames(iter(records)))
    assert parts[0][:4] == (0x184D2A5D).to_bytes(4, "little") and len(parts) == 901
    trained = zstandard.ZstdCompressionDict(parts[0][8:])
    read = zstandard.ZstdDecompressor(dict_data=trained)
    assert [read.decompress(x) for x in parts[1:]] == records  # each frame alone, with the head's dictionary
    alone = zstandard.ZstdCompressor(level=warc.LEVEL)
    assert sum(map(len, parts[1:])) < sum(len(alone.compress(x)) for x in records) / 1.5
    assert list(warc.unframe(warc.SEPARATOR.join(parts) + warc.SEPARATOR)) == records
    assert list(warc.frames(iter([]))) == []
    with pytest.raises(ValueError):
        list(warc.unframe(b"".join(parts)[:-3]))


def test_broken_payload_is_an_error(spark, tmp_path):
    raw = warc.record(1, "u", b"x" * 200, "0" * 64, None, False)
    with pytest.raises(ValueError):
        warc.parse(raw[:-4])
    spark.createDataFrame([(list(warc.frames(iter([raw] * 20))),)], "v array<binary>").select(F.explode("v").alias("v")).select(F.col("v").cast("string").alias("value")).coalesce(1).write.option(
        "lineSep", warc.SEPARATOR.decode()).text(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archives(spark, f"{tmp_path}/bad").collect()


def test_no_pages(spark, table):
    sf = table(pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert QUERIES["op3_warc"](spark, sf).collect() == []
