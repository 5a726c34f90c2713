"""Plan shape (pushdown, pruning, no Python UDFs, partial aggregation) and invariants."""

from pyspark.sql import functions as F

from tillgrid.operators import clean, metrics
from tillgrid.operators import forecast as fc
from tillgrid.operators.joins import estimated_bytes, sized_broadcast
from tillgrid.plans.catalog import QUERIES, processed
from tillgrid.sources.sinks import write_partitioned
from tillgrid.plans.prepare import stages
from tillgrid.sources.testdata import sales_view, table
from oracle_harness import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udfs_in_any_registered_query(spark):
    for name, fn in QUERIES.items():
        p = plan(fn(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_filters_reach_the_scan(spark):
    p = plan(metrics.filtered_kpis(processed(spark, SF_SMALL), category="LARGE", region="ASIA", year="1998"))
    assert "PartitionFilters: [isnotnull(year" in p
    assert "EqualTo(category,LARGE)" in p and "EqualTo(region,ASIA)" in p


def test_column_pruning_on_processed(spark):
    p = plan(metrics.units_by_month(processed(spark, SF_SMALL)))
    assert "ReadSchema: struct<units_sold:double>" in p or "ReadSchema: struct<units_sold:double," in p


def test_stored_status_reaches_the_scan(spark, tmp):
    from tillgrid.operators import jobs

    jobs.with_status_badge(table(spark, SF_SMALL, "events"), "event_type").write.parquet(f"{tmp}/jobs")
    rows = jobs.by_status(spark.read.parquet(f"{tmp}/jobs"), "status_norm", "error", "ts", stored=True)
    assert "EqualTo(status_norm,ERROR)" in plan(rows)
    assert rows.count() == jobs.by_status(table(spark, SF_SMALL, "events"), "event_type", "error", "ts").count() > 0


def test_reports_scan_once_and_cache_nothing(spark):
    p = processed(spark, SF_SMALL)
    cube = metrics.report_cube(metrics.with_revenue(p), materialise=False)
    assert plan(cube).count("FileScan") == 1 and "Expand" in plan(cube)
    fine = plan(cube).split("Expand", 1)[1]
    assert "HashAggregate" in fine  # grouping sets expand the finest grain, not raw rows
    from tillgrid.plans import reports
    reports.business_metrics(p).collect()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_alarm_condition_reaches_the_scan(spark):
    from tillgrid.operators import jobs

    rows = jobs.window_alarm(table(spark, SF_SMALL, "events"), "ts", F.col("event_type") == "error")
    assert "EqualTo(event_type,error)" in plan(rows)


def test_keyed_sums_aggregate_partially(spark):
    p = plan(metrics.category_sales(processed(spark, SF_SMALL)))
    assert "partial_sum" in p


def test_latest_per_key_uses_group_limit(spark):
    from tillgrid.operators import jobs
    p = table(spark, SF_SMALL, "events")
    df = jobs.latest_per_key(p, "user_id", "ts", 5, "event_id")
    df._jdf.queryExecution().executedPlan()  # force planning
    assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString() or \
        "WindowGroupLimit" in plan(df)


def test_job_table_layout(spark, tmp):
    """A status reads its partition, a job id skips row groups that can't hold it."""
    from tillgrid.operators import jobs

    before = table(spark, SF_SMALL, "events")
    rows = before.unionByName(before.withColumn("event_id", F.col("event_id") + 1_000_000)).repartition(1)
    key = "parquet.block.size"
    conf = spark._jsc.hadoopConfiguration()
    conf.set(key, "16384")
    try:
        held = jobs.store_jobs(rows, f"{tmp}/jobs", "event_type", "user_id", ["event_id"])
    finally:
        conf.unset(key)
    one = jobs.by_status(held, "job_status", "error", "ts", "event_id", stored=True)
    assert "PartitionFilters: [isnotnull(job_status" in plan(one) and "= ERROR)" in plan(one)
    assert one.count() == rows.where("upper(event_type) = 'ERROR'").count() > 0
    from pathlib import Path

    import pyarrow.parquet as pq
    meta = [pq.ParquetFile(f).metadata for f in Path(tmp, "jobs").rglob("*.parquet")]
    groups = [(m.row_group(i).column(j).statistics.min, m.row_group(i).column(j).statistics.max) for m in meta for i in range(m.num_row_groups)
              for j in range(m.num_columns) if m.row_group(i).column(j).path_in_schema == "user_id"]
    user = before.agg(F.min("user_id")).first()[0]
    assert len(groups) > 8 and sum(a <= user <= b for a, b in groups) <= len(groups) / 2  # sorted: few row groups hold a user
    found = jobs.lookup(held, "event_id", 42)
    assert "EqualTo(event_id,42)" in plan(found) and found.count() == before.where("event_id = 42").count()


def test_validation_report_is_one_pass(spark):
    from tillgrid.operators import quality

    df = sales_view(spark, SF_SMALL)
    assert plan(quality.validation_report(df)).count("FileScan parquet") == plan(df).count("FileScan parquet") == 6


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_broadcast_only_behind_a_size_check(spark):
    li, nation = table(spark, SF_SMALL, "lineitem"), table(spark, SF_SMALL, "nation")
    assert estimated_bytes(li) > estimated_bytes(nation) > 0
    key = li["l_orderkey"] == nation["n_nationkey"]
    assert "strategy=broadcast" in optimized(li.join(sized_broadcast(nation), key))
    assert "strategy=broadcast" not in optimized(li.join(sized_broadcast(nation, limit_bytes=estimated_bytes(nation) - 1), key))


def test_written_files_follow_the_bytes(spark, tmp):
    import glob

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, counts = spark.conf.get(key), []
    try:
        for size in ("64MB", "8KB"):
            spark.conf.set(key, size)
            df = table(spark, SF_SMALL, "lineitem").repartition(12).withColumn("year", F.when(F.col("l_linenumber") == 7, 1998).otherwise(1997))
            path = write_partitioned(df, f"{tmp}/{size}")
            counts.append(len(glob.glob(f"{path}/year=1997/*.parquet")))
            assert spark.read.parquet(path).count() == df.count()
    finally:
        spark.conf.set(key, before)
    assert counts[0] == 1 and counts[1] > 4  # the hot year is split by its size


def test_invariants(spark):
    p = processed(spark, SF_SMALL)
    tot = p.agg(F.sum("units_sold")).first()[0]
    cats = metrics.category_sales(p).agg(F.sum("total_units")).first()[0]
    nulls = p.filter(F.col("category").isNull()).agg(F.coalesce(F.sum("units_sold"), F.lit(0.0))).first()[0]
    assert cats == tot - nulls
    share = metrics.shares(p, "region").agg(F.sum("share_pct")).first()[0]
    assert abs(share - 100) < 0.05
    assert metrics.apply_filters(p).count() == p.count()
    st = stages(sales_view(spark, SF_SMALL))
    assert st.kept.count() + clean.outlier_anomalies(st.cleaned).count() == st.cleaned.count()
    s = fc.growth_summary(fc.monthly_totals(p)).first()
    steps = [r["forecast"] for r in fc.forecast_steps(fc.growth_summary(fc.monthly_totals(p))).orderBy("step").collect()]
    for a, b in zip(steps, steps[1:]):
        assert abs(b / a - (1 + s["avg_growth"])) < 1e-3
