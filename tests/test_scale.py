"""Steps whose cost must follow the input: narrow de-duplication, writes without a shuffle, uploads and headers. Rows are built here."""

import gzip
import os
import re
from datetime import datetime

from pyspark.sql import functions as F

from tillgrid.functions.numbers import coerce_number
from tillgrid.operators import clean, joins
from tillgrid.sources import files, ingest, testdata
from tillgrid.sources.sinks import write_partitioned
from tillgrid.streaming import uploads


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def star(spark, base):
    """A star with repeated and null keys, lookups that repeat a key, and line items that differ only in what the view doesn't show."""
    day = datetime(2020, 3, 4)
    line = [(o, p, s, n, q, 10.0 * q, d, 0.1, f, "O", day) for o, p, s, n, q, d, f in [
        (1, 1, 1, 1, 2.0, 0.1, "A"), (1, 1, 1, 1, 2.0, 0.1, "A"), (2, 1, 1, 1, 2.0, 0.1, "A"), (3, 1, 1, 1, 2.0, 0.1, "A"), (1, 1, 2, 1, 2.0, 0.1, "R"), (1, 1, 2, 1, 2.0, 0.2, "R"),
        (2, 2, 1, 3, 5.0, None, "R"), (2, 2, 1, 3, 5.0, 0.0, "R"), (None, 1, 1, 1, 2.0, 0.1, "A"), (1, None, 1, 1, 2.0, 0.1, "A"), (1, 3, None, 2, 4.0, 0.1, None), (3, 3, 3, 2, 4.0, 0.1, None)]]
    tables = {
        "lineitem": (line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                           "l_linestatus string, l_shipdate timestamp_ntz"),
        "orders": ([(1, "1-URGENT"), (2, "1-URGENT"), (3, "5-LOW"), (3, "5-LOW"), (None, "2-HIGH")], "o_orderkey long, o_orderpriority string"),
        "part": ([(1, "PROMO", 1, 3.0), (1, "PROMO", 1, 3.0), (1, None, 1, 3.0), (2, "LARGE", 2, 4.0), (3, "LARGE", None, None), (None, "LARGE", 2, 4.0)],
                 "p_partkey long, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(1, 0), (1, 0), (2, 1), (3, 1), (None, 0)], "s_suppkey long, s_nationkey int"),
        "nation": ([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"), "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}.parquet")
    return base


def rows(df):
    return sorted(map(str, df.collect()))


def test_early_distinct_rows_are_the_distinct_rows(spark, tmp, monkeypatch):
    base = star(spark, tmp)
    whole = testdata.sales_view(spark, base)
    changes = {"category": F.when(F.col("category") != "PROMO", F.col("category")), "region": F.when(F.col("region") != "AFRICA", F.col("region")),
               "discount": F.when(F.col("weather_condition") != "R", F.col("discount"))}
    assert rows(testdata.sales_view(spark, base, changes=changes)) == rows(whole.withColumns(changes))
    for limit in (joins.BROADCAST_LIMIT_BYTES, 0):
        monkeypatch.setattr(testdata, "sized_broadcast", lambda df, limit=limit: joins.sized_broadcast(df, limit))
        early = testdata.sales_view(spark, base, distinct=True)
        assert early.columns == whole.columns and rows(early) == rows(whole.dropDuplicates())
        assert whole.count() > early.count() > 0
        assert rows(testdata.sales_view(spark, base, distinct=True, changes=changes)) == rows(whole.withColumns(changes).dropDuplicates())


def test_lookups_are_not_shuffled_with_the_facts(spark, tmp):
    dealt = re.findall(r"Exchange hashpartitioning\(.*", plan(testdata.sales_view(spark, star(spark, tmp), distinct=True)))
    facts = [x for x in dealt if "units_sold" in x or "l_quantity" in x]
    assert facts and not any(c in x for x in facts for c in ("category", "p_type", "region", "r_name", "price", "store_id", "product_id", "seasonality"))


def test_parts_are_broadcast_by_their_rows_not_by_their_files(spark, tmp):
    """Half a GB in a hash table may lie in a file of a few MB; the rows are dealt by part key then, still as narrow as with small parts."""
    base = star(spark, tmp)
    few = spark.read.parquet(f"{base}/part.parquet")
    many = spark.range(10, joins.HELD_LIMIT_BYTES // joins.held_bytes(few, 1) + 1000).selectExpr("id p_partkey", "'LARGE' p_type", "1 p_size", "2.0D p_retailprice")
    expected = rows(testdata.sales_view(spark, base).dropDuplicates())
    assert joins.fits_broadcast(few)
    many.unionByName(few).write.mode("overwrite").parquet(f"{base}/more")
    spark.read.parquet(f"{base}/more").write.mode("overwrite").parquet(f"{base}/part.parquet")
    part = spark.read.parquet(f"{base}/part.parquet")
    assert joins.sized_broadcast(part) is not part and not joins.fits_broadcast(part)
    for distinct in (False, True):
        view = testdata.sales_view(spark, base, distinct=distinct)
        assert not re.search(r"BroadcastExchange HashedRelationBroadcastMode\S*\n[^\n]*p_partkey", plan(view)) and "hashpartitioning(p_partkey" in plan(view)
        assert rows(view if distinct else view.dropDuplicates()) == expected
    facts = [x for x in re.findall(r"Exchange hashpartitioning\(.*", plan(view)) if "units_sold" in x or "l_quantity" in x]
    assert facts and not any(c in x for x in facts for c in ("category", "region", "price", "store_id"))


def test_line_items_are_not_dealt_by_their_order(spark, tmp, monkeypatch):
    """Orders are looked up in a packed table at any size; repeated, null and negative keys, and several promotions of a key, give the joined rows."""
    base = star(spark, tmp)
    orders = [(k, p) for k, p in [(1, "1-URGENT"), (1, "2-HIGH"), (1, "2-HIGH"), (2, None), (3, "4-NOT SPECIFIED"), (None, "2-HIGH"), (-5, "3-MEDIUM"), (2**62, "x")]]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.mode("overwrite").parquet(f"{base}/orders.parquet")
    line = spark.read.parquet(f"{base}/lineitem.parquet").limit(4)
    more = [line.withColumn("l_orderkey", F.lit(k).cast("long")) for k in (-5, 2**62, 7, -6)]
    testdata.table(spark, base, "lineitem").unionByName(more[0]).unionByName(more[1]).unionByName(more[2]).unionByName(more[3]).write.parquet(f"{base}/line")
    spark.read.parquet(f"{base}/line").write.mode("overwrite").parquet(f"{base}/lineitem.parquet")
    expected = rows(testdata.sales_view(spark, base).dropDuplicates())
    assert len({r.split("holiday_promotion=")[1][:4] for r in expected}) == 5
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)  # tables of any size
    try:
        for width, packed in ((testdata.BLOCK_BYTES, True), (1 << 40, False)):
            monkeypatch.setattr(testdata, "BLOCK_BYTES", width)
            early = testdata.sales_view(spark, base, distinct=True)
            assert ("hashpartitioning(l_orderkey" not in plan(early)) == packed
            assert rows(early) == expected
        monkeypatch.setattr(testdata, "MARK_BYTES", 1 << 40)  # too many repeated rows
        assert rows(testdata.sales_view(spark, base, distinct=True)) == expected
    finally:
        spark.conf.set(key, before)


def test_write_without_rebalancing(spark, tmp):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    df = spark.range(0, 900, 1, 3).select("id", (F.col("id") % 4 + 2000).cast("int").alias("year"))
    back = spark.read.parquet(write_partitioned(df, f"{tmp}/out", rebalance=False))
    assert rows(back.select("id", "year")) == rows(df) and spark.conf.get(key) == before
    assert len(os.listdir(f"{tmp}/out/year=2001")) >= 3  # each task its own file: nothing was dealt by year


def test_bucket_sizes():
    """A bucket's rows are sorted by one task, so buckets follow the input from a few hundred MB on."""
    assert [ingest.bucket_count(n << 20) for n in (100, 1024, 6144)] == [8, 32, 256]


def test_group_bounds_are_broadcast(spark, tmp):
    """Rows of an upload aren't gathered in one task: bounds are a row per group, however large the estimate."""
    df = spark.range(2000).select((F.col("id") % 3).alias("job_id"), F.col("id").cast("double").alias("units_sold"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, limit = spark.conf.get(key), joins.BROADCAST_LIMIT_BYTES
    spark.conf.set(key, -1)
    try:
        joins.sized_broadcast.__defaults__ = (0,)  # an input of any size
        kept = clean.outlier_fence(df, "units_sold", by=["job_id"])
        assert "BroadcastHashJoin" in plan(kept) and "SortMergeJoin" not in plan(kept)
        assert kept.count() == 2000
    finally:
        joins.sized_broadcast.__defaults__ = (limit,)
        spark.conf.set(key, before)


def test_parts_are_folders(spark, tmp):
    """Parts that the ledger names are picked by folder; no row is shuffled for it."""
    parts = [("a", "p-one", 1), ("a", "p-two", 2), ("b", "p-one", 3), ("b", "p-lost", 4)]
    spark.createDataFrame(parts, "job_id string, part string, n int").write.partitionBy("job_id", "part").parquet(f"{tmp}/cleaned")
    named = [uploads.UploadFile(j, f"/{j}", 1, 1, p, "") for j, p in (("a", "p-one"), ("a", "p-two"), ("b", "p-one"))]
    found = uploads.cleaned_parts(spark, tmp, named)
    assert "Join" not in plan(found) and "Exchange" not in plan(found) and "part" in plan(found).split("PartitionFilters", 1)[1]
    assert sorted(r["n"] for r in found.collect()) == [1, 2, 3]


def test_headers_are_read_without_a_job(spark, tmp):
    base = os.path.join(tmp, "in")
    os.makedirs(base)
    texts = {"a b%20+.csv": b"x,y\r\n1,2\r\n", "c.csv": "﻿x,y\n3,4\n".encode(), "e.csv": b"", "f.csv": b"y,x\n6,5"}
    for name, text in texts.items():
        with open(os.path.join(base, name), "wb") as out:
            out.write(text)
    with gzip.open(os.path.join(base, "d.csv.gz"), "wb") as out:
        out.write(b"x,y\n7,8\n")
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    try:
        groups = files.header_groups(spark, base)
        assert not sc.statusTracker().getJobIdsForGroup("headers")
    finally:
        sc._jsc.clearJobGroup()
    assert [(head, [os.path.basename(f) for f in names]) for head, names in groups] == [("x,y", ["a b%20+.csv", "c.csv", "d.csv.gz"]), ("y,x", ["f.csv"])]
    assert sorted((r["x"], r["y"]) for r in files.read_sales_csv(spark, base).collect()) == [("1", "2"), ("3", "4"), ("5", "6"), ("7", "8")]


def test_numbers_are_coerced_as_one_array(spark):
    cells = [None, "", " 1.5 ", "-0", "1e999", "NaN", "inf", "1d", "1,000", ".5", "+2.", "True", "7\n"]
    df = spark.createDataFrame([(c, c, 1.5) for c in cells], "price string, discount string, units_sold double")
    out = clean.coerce_numeric(df)
    assert plan(out).count("RLIKE") == 1  # not once per column and use
    want = df.select(*[coerce_number(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns])
    assert out.columns == df.columns and rows(out) == rows(want)
