"""Sources and sinks: round trips through temporary folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tillgrid.plans.catalog import processed
from tillgrid.sources import files, sinks
from tillgrid.sources.testdata import sales_view
from oracle_harness import SF_SMALL


def _sales_sample(spark):
    return sales_view(spark, SF_SMALL).orderBy("date", "store_id", "product_id", "units_sold").limit(200)


def test_csv_round_trip_all_string(spark, tmp):
    src = _sales_sample(spark)
    sinks.write_csv(src, os.path.join(tmp, "csv"))
    back = files.read_sales_csv(spark, os.path.join(tmp, "csv"))
    assert all(t == "string" for _, t in back.dtypes)
    assert back.count() == 200
    from tillgrid.plans.prepare import prepare
    p = prepare(back)
    assert dict(p.dtypes)["units_sold"] == "double" and dict(p.dtypes)["date"] == "date"


def test_na_tokens_become_null(spark, tmp):
    p = os.path.join(tmp, "na.csv")
    with open(p, "w") as fh:
        fh.write("category,region\nNA,N/A\nnull,x\n")
    rows = files.read_sales_csv(spark, p).collect()
    assert rows[0]["category"] is None and rows[0]["region"] is None and rows[1]["region"] == "x"


def test_partitioned_processed_table_prunes_years(spark):
    df = processed(spark, SF_SMALL)
    plan = df.filter(F.col("year") == 1997)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year" in plan


def test_landing_zone_job_ids(spark, tmp):
    src = _sales_sample(spark)
    for job in ("job-a", "job-b"):
        sinks.write_csv(src.limit(10), os.path.join(tmp, "landing", job))
    df = files.read_landing(spark, os.path.join(tmp, "landing"))
    got = {r["job_id"]: r["n"] for r in df.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"job-a": 10, "job-b": 10}


def test_manifest_scan(spark, tmp):
    src = _sales_sample(spark).limit(20)
    data = os.path.join(tmp, "data")
    src.write.option("header", True).option("sep", ";").csv(data)
    man = {"fileLocations": [{"URIPrefixes": [data]}],
           "globalUploadSettings": {"format": "CSV", "delimiter": ";", "textqualifier": "\"", "containsHeader": "true"}}
    mp = os.path.join(tmp, "manifest.json")
    with open(mp, "w") as fh:
        json.dump(man, fh)
    df = files.read_manifest(spark, mp)
    assert df.count() == 20 and "units_sold" in df.columns


def test_json_payloads(spark, tmp):
    p = os.path.join(tmp, "start.json")
    with open(p, "w") as fh:
        json.dump({"job_id": "run-7", "user_id": "ann", "filename": "till.csv", "operation": "forecasting",
                   "description": "weekly", "s3_input_key": "in/run-7/till.csv",
                   "created_at": "2025-11-02T07:05:09Z"}, fh, indent=2)
    df = files.payload_times(files.read_payloads(spark, p), ["created_at"])
    r = df.first()
    assert r["operation"] == "forecasting" and str(r["created_at"]) == "2025-11-02 07:05:09"
    ev = spark.createDataFrame([('{"job_id":"j1","status":"RUNNING","stage":"ETL","message":"m","updated_at":"x"}',)], "v string")
    assert files.parse_payload_column(ev, "v").first()["payload"]["status"] == "RUNNING"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_columns_follow_each_file_s_header(spark, tmp):
    write(f"{tmp}/in/a.csv", "Date,Units Sold,price\n2024-01-05,10,2.5\n")
    write(f"{tmp}/in/b.csv", "price, units_sold ,DATE\n3.5,20,2024-01-06\n")
    rows = {r["date"]: (r["units_sold"], r["price"]) for r in files.read_sales_csv(spark, f"{tmp}/in").collect()}
    assert rows == {"2024-01-05": ("10", "2.5"), "2024-01-06": ("20", "3.5")}
    write(f"{tmp}/in/c.csv", "date,price\n2024-01-07,1\n")
    with pytest.raises(ValueError, match="units_sold.*c.csv"):
        files.read_sales_csv(spark, f"{tmp}/in")


def test_landing_by_header(spark, tmp):
    write(f"{tmp}/landing/j1/a.csv", "units_sold,price\n1,10\n")
    write(f"{tmp}/landing/j2/b.csv", "price,units_sold\n20,2\n")
    got = {r["job_id"]: (r["units_sold"], r["price"]) for r in files.read_landing(spark, f"{tmp}/landing").collect()}
    assert got == {"j1": ("1", "10"), "j2": ("2", "20")}
    assert [r["job_id"] for r in files.read_landing(spark, f"{tmp}/landing", jobs=["j2"]).collect()] == ["j2"]


def test_line_breaks_in_cells_and_malformed_records(spark, tmp):
    write(f"{tmp}/m.csv", 'category,region\n"two\nlines",x\nplain,y\n')
    rows = files.read_sales_csv(spark, f"{tmp}/m.csv", multi_line=True).collect()
    assert [(r["category"], r["region"]) for r in rows] == [("two\nlines", "x"), ("plain", "y")]
    write(f"{tmp}/bad.csv", "a,b\n1,2\n3\n4,5,6\n7,8\n")
    df = files.read_sales_csv(spark, f"{tmp}/bad.csv", malformed=True).cache()
    assert sorted(r[0] for r in df.where(F.col(files.MALFORMED).isNotNull()).select(files.MALFORMED).collect()) == ["3", "4,5,6"]


def test_crawl_and_publish(spark, tmp):
    src = _sales_sample(spark).limit(30)
    sinks.write_csv(src, os.path.join(tmp, "raw"))
    t = files.crawl_to_parquet(spark, os.path.join(tmp, "raw"), os.path.join(tmp, "etl"))
    assert dict(t.dtypes)["units_sold"] == "double" and t.count() == 30
    named = files.crawl_to_parquet(spark, os.path.join(tmp, "raw"), os.path.join(tmp, "named"), table="crawled_sales")
    assert named.count() == spark.table("crawled_sales").count() == 30
    spark.sql("DROP TABLE crawled_sales")
    first = sinks.publish_latest(t, os.path.join(tmp, "pub"))
    assert sinks.read_latest(spark, os.path.join(tmp, "pub")).count() == 30
    sinks.publish_latest(t.limit(7), os.path.join(tmp, "pub"))
    assert sinks.read_latest(spark, os.path.join(tmp, "pub")).count() == 7
    assert spark.read.parquet(first).count() == 30  # a reader of the old version isn't disturbed
    files.copy_raw(spark, os.path.join(tmp, "raw"), os.path.join(tmp, "rawcopy"))
    assert spark.read.text(os.path.join(tmp, "rawcopy")).count() == spark.read.text(os.path.join(tmp, "raw")).count()


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from tillgrid import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_signature_sees_changes(spark, tmp):
    from tillgrid.plans.catalog import _signature

    for name in ("lineitem", "orders", "part", "supplier", "nation", "region"):
        spark.range(3).write.parquet(f"{tmp}/{name}.parquet")
    before = _signature(spark, tmp)
    assert before == _signature(spark, tmp)
    spark.range(4).write.mode("overwrite").parquet(f"{tmp}/part.parquet")
    assert before != _signature(spark, tmp)
