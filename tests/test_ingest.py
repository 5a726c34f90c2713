"""S6 with C1: co-bucketed facts are joined without a shuffle and give the same processed rows."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from oracle_harness import SF_SMALL
from tillgrid.operators import joins
from tillgrid.plans.prepare import prepare
from tillgrid.sources import ingest, testdata


@pytest.fixture()
def no_broadcast(spark, monkeypatch):
    """Every lookup counts as large, as on a cluster."""
    monkeypatch.setattr(testdata, "sized_broadcast", lambda df: joins.sized_broadcast(df, 0))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def facts(spark, buckets=None):
    return ingest.ingest_facts(spark, testdata.table(spark, SF_SMALL, "lineitem"), testdata.table(spark, SF_SMALL, "orders"), buckets=buckets)


def test_no_exchange_on_the_order_key(spark, no_broadcast):
    plain, bucketed = testdata.sales_view(spark, SF_SMALL), testdata.sales_view(spark, SF_SMALL, facts(spark))
    assert sum("orderkey" in x for x in exchanges(plain)) == 2
    assert not any("orderkey" in x for x in exchanges(bucketed))
    assert len(exchanges(bucketed)) == len(exchanges(plain)) - 2


def test_repeated_rows_meet_without_another_exchange(spark, no_broadcast):
    own = facts(spark)
    joined = testdata.sales_view(spark, SF_SMALL, own)
    assert len(exchanges(testdata.sales_view(spark, SF_SMALL, own, distinct=True))) == len(exchanges(joined))
    assert len(exchanges(joined.dropDuplicates())) == len(exchanges(joined)) + 1


def test_processed_rows_are_the_same(spark, no_broadcast):
    twice = testdata.table(spark, SF_SMALL, "lineitem")
    twice = twice.unionByName(twice.where("l_linenumber = 1"))  # repeated rows, which cleaning drops
    own = ingest.ingest_facts(spark, twice, testdata.table(spark, SF_SMALL, "orders"), buckets=4)
    plain = prepare(testdata.sales_view(spark, SF_SMALL))
    bucketed = prepare(testdata.sales_view(spark, SF_SMALL, own, distinct=True), distinct=True)
    total = [F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(plain.columns)).cast("decimal(38,0)"))]
    assert plain.agg(*total).first() == bucketed.agg(*total).first()


def test_a_bucket_is_one_sorted_file(spark, tmp):
    df = ingest.ingest_bucketed(testdata.table(spark, SF_SMALL, "orders"), "orders_in_buckets", f"{tmp}/orders", "o_orderkey", 4)
    files = glob.glob(f"{tmp}/orders/*.parquet")
    assert len(files) == 4 and df.count() == testdata.table(spark, SF_SMALL, "orders").count()
    for f in files:
        keys = [r[0] for r in spark.read.parquet(f).select("o_orderkey").coalesce(1).collect()]
        assert keys == sorted(keys)


def test_bucket_count():
    assert ingest.bucket_count(0) == 8 and ingest.bucket_count(100 << 40) == 1 << 16
    assert all(ingest.bucket_count(n) & (ingest.bucket_count(n) - 1) == 0 for n in (1, 10**9, 10**12))
