"""The pipeline's stages against brute force, each on what its predecessor kept."""

import importlib.util

import pytest
from test_documents import brute_hits
from test_near_duplicates import brute_lines, fingerprint, near_texts, unite

from tillgrid.llm import quality as operator
from tillgrid.llm.common import cut

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline in this checkout")

NAMES = ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


@pytest.fixture(scope="module")
def world(spark, frame, odd, table):
    rows = near_texts() + [(300 + i, t) for i, t in enumerate(["spam spam spam spam !!! ###"] * 30 + ["junk ### !!! junk ### junk"] * 30)]
    rows += [(400 + i, f"clean {'abcdefghijklmnop'[i]} words of sense {'qrstuvwxyzabcdef'[i]}") for i in range(16)] + odd
    leak = "one of the items that a benchmark asks about and more"
    rows += [(500, f"clean words before {leak} and behind"), (501, leak.upper())]
    labels = [(i, int(i < 300 or i >= 400), 0) for i, _ in rows if i is not None and i % 5]
    sf = table(documents=frame(rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
               benchmark=spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string"))
    return sf, rows


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def same(a, b):
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_stages_match_brute_force(spark, world):
    import corpus_pipeline as pipeline

    sf, rows = world
    assert [name for name, _ in pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = []
    for name, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), f"test-{name}")
        out.append(docs)
    assert all(df.columns == columns for df in out[:-1])

    model = operator.scorer(*operator.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")))
    good = [(i, t) for i, t in rows if model(t) >= 0.3]
    assert len(good) < len(rows) and all(r in good for r in rows if r[0] is not None and 400 <= r[0] < 420)
    same(rows_of(out[0]), good)

    gone = brute_lines(good)
    short = [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in good]
    same(rows_of(out[1]), short)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out[1].collect())

    prints = [(i, fingerprint(t)) for i, t in short if i is not None]
    own = sorted({p for _, p in prints})
    part = unite(own, [(a, b) for a in own for b in own if a < b and (a ^ b).bit_count() <= 4])
    first = {}
    for i, p in prints:
        first[part[p]] = min(i, first.get(part[p], i))
    kept = rows_of(out[2])
    assert sorted(i for i, _ in kept if i is not None) == sorted(first.values())
    assert all(r in short for r in kept) and sum(i is None for i, _ in kept) == sum(i is None for i, _ in short)

    dirty = {e[0] for e in brute_hits(kept, [(1, "one of the items that a benchmark asks about and more"), (2, None)]) if e[-1]}
    same(rows_of(out[3]), [(i, t) for i, t in kept if str(i) not in dirty])
    assert dirty

    pieces = out[4].collect()
    totals = {}
    for r in pieces:
        totals[str(r["doc_id"])] = totals.get(str(r["doc_id"]), 0) + r["length"]
    assert set(totals) == {str(i) for i, _ in rows_of(out[3])}
    places = sorted((r["sequence_id"] * 1024 + r["offset"], r["length"]) for r in pieces)
    at = 0
    for start, length in places:
        assert start == at
        at += length


def test_run_of_nothing(spark, frame, table):
    import corpus_pipeline as pipeline

    sf = table(documents=frame([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert pipeline.run(spark, sf).collect() == []


def test_registered():
    import re

    import __spark_entry__ as entry

    numbers = sorted(int(m[1]) for q in entry.queries() if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert {q for q in entry.oracle_sql() if re.match(r"op\d+_", q)} == {"op2_mtree", "op3_warc", "op12_centroids"}
