"""Hand-written trap fixtures (FX1-FX12) with golden answers."""

import os

import pytest
from pyspark.sql import functions as F

from tillgrid.config import REQUIRED_COLUMNS
from tillgrid.functions.text import month_name, rewrite_month_numbers, currency_text, forecast_range_text
from tillgrid.operators import quantiles, clean, jobs, metrics, quality, ranking
from tillgrid.operators import forecast as fc
from tillgrid.plans import reports
from tillgrid.plans.prepare import prepare
from tillgrid.sources.files import read_sales_csv

HEADER = ",".join(REQUIRED_COLUMNS)


def sales_csv(tmp, rows, header=HEADER, name="sales.csv"):
    p = os.path.join(tmp, name)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(header + "\n")
        for r in rows:
            fh.write(r + "\n")
    return p


def row(date="2022-01-05", cat="A", reg="North", units="10", price="2.5", discount="5", promo="Yes",
        store="S1", product="P1"):
    return f"{date},{store},{product},{cat},{reg},100,{units},12,11,{price},{discount},Sunny,{promo},2.4,Winter"


# FX1 dirty headers with BOM
def test_fx1_dirty_headers(spark, tmp):
    p = os.path.join(tmp, "h.csv")
    with open(p, "w", encoding="utf-8-sig") as fh:
        fh.write(" Units Sold ,Holiday/Promotion,Competitor Pricing\n1,Yes,2\n")
    df = clean.normalise_headers(read_sales_csv(spark, p))
    assert df.columns == ["units_sold", "holiday_promotion", "competitor_pricing"]


def test_fx1_header_collision_raises(spark):
    df = spark.createDataFrame([(1, 2)], ["Units Sold", "units_sold"])
    with pytest.raises(ValueError, match="collide"):
        clean.normalise_headers(df)


# FX2 bad cells
def test_fx2_bad_cells(spark, tmp):
    rows = [row(date="13/02/2022", units="12"), row(date="2022-01-13", units="x"),
            row(date="bad", units="5"), row(date="", units="5"), row(date="2022-03-01", units=" 2 "),
            row(date="2022-03-02", units='"1,000"'), row(date="2022-03-03", units="NaN"),
            row(date="2022-03-04", units="1e3")]
    df = read_sales_csv(spark, sales_csv(tmp, rows))
    out = clean.drop_missing(clean.coerce_numeric(clean.drop_missing(clean.parse_dates(df), ["date"])), ["units_sold"])
    got = sorted((str(r["date"]), r["units_sold"]) for r in out.select("date", "units_sold").collect())
    assert got == [("2022-02-13", 12.0), ("2022-03-01", 2.0), ("2022-03-04", 1000.0)]


# FX3 duplicates
def test_fx3_duplicates(spark, tmp):
    rows = [row(), row(), row(price=""), row(price=""), row(units="11"), row(store="S2")]
    df = read_sales_csv(spark, sales_csv(tmp, rows))
    assert clean.dedup_rows(df).count() == 4
    assert clean.dedup_rows(clean.dedup_rows(df)).count() == 4


# FX4 null keys
def test_fx4_null_keys(spark, tmp):
    rows = [row(cat="A", units="10"), row(cat="", units="5", store="S2"), row(cat="NA", units="7", store="S3"),
            row(reg="", units="3", store="S4"), row(cat="B", units="8", store="S5")]
    p = prepare(read_sales_csv(spark, sales_csv(tmp, rows)))
    tot = metrics.dual_kpis(metrics.with_revenue(p)).first()["total_units"]
    cats = {r["category"]: r["total_units"] for r in metrics.category_sales(p).collect()}
    assert tot == 33  # the NULL-category rows ("" and the "NA" token) still count in the total
    assert cats == {"A": 13.0, "B": 8.0}
    shares = {r["category"]: r["share_pct"] for r in metrics.shares(p, "category").collect()}
    assert shares == {"A": round(13 / 33 * 100, 2), "B": round(8 / 33 * 100, 2)}


# FX5 degenerate months
def _monthly(spark, pairs):
    return spark.createDataFrame(pairs, "period int, total_units double")


def test_fx5_single_month(spark):
    s = fc.growth_summary(_monthly(spark, [(3, 10.0)])).first()
    assert s["status"] == "insufficient_history" and s["avg_growth"] is None


def test_fx5_zero_month(spark):
    s = fc.growth_summary(_monthly(spark, [(1, 0.0), (2, 5.0)])).first()
    assert s["status"] == "undefined_growth" and s["avg_growth"] is None


def test_fx5_flat_months(spark):
    m = _monthly(spark, [(1, 5.0), (2, 5.0), (3, 5.0)])
    s = fc.growth_summary(m)
    row_ = s.select(fc.trend(F.col("avg_growth")).alias("t"), fc.confidence(F.col("avg_growth")).alias("c"),
                    fc.strength(F.col("avg_growth")).alias("s"), fc.risk(F.col("avg_growth")).alias("r"),
                    "avg_growth", "status").first()
    assert row_["avg_growth"] == 0.0 and row_["status"] == "ok"
    assert (row_["t"], row_["c"], row_["s"], row_["r"]) == ("decreasing", "Low", "Moderate Decline", "Stable Demand ✅")
    steps = [r["forecast"] for r in fc.forecast_steps(s).orderBy("step").collect()]
    assert steps == [5.0] * 6


def test_fx5_compounding_matches_loop(spark):
    m = _monthly(spark, [(1, 100.0), (2, 110.0), (3, 99.0)])
    s = fc.growth_summary(m).first()
    g = ((110 / 100 - 1) + (99 / 110 - 1)) / 2
    cur, want = 99.0, []
    for _ in range(6):
        cur = cur * (1 + g)
        want.append(round(cur, 2))
    got = [r["forecast"] for r in fc.forecast_steps(fc.growth_summary(m)).orderBy("step").collect()]
    assert abs(s["avg_growth"] - g) < 1e-15
    assert got == want


# FX6 ties
def test_fx6_ties_smallest_key(spark):
    k = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 1.0), ("d", 1.0)], "category string, total_units double")
    bw = ranking.best_worst(k, "category").first()
    assert (bw["best_category"], bw["worst_category"]) == ("a", "c")
    top = [r["category"] for r in ranking.top_k(k, "category", 3).orderBy("rank").collect()]
    assert top == ["a", "b", "c"]
    bottom = [r["category"] for r in ranking.bottom_k(k, "category", 3).orderBy("rank").collect()]
    assert bottom == ["b", "c", "d"]


# FX7 promotion flags
def test_fx7_promotion_flags(spark):
    vals = ["yes", "YES", "true", "1", "1.0", "no", None, "0"]
    df = spark.createDataFrame([(v,) for v in vals], "holiday_promotion string")
    from tillgrid.functions.text import promotion_flag
    got = [r[0] for r in df.select(promotion_flag(F.col("holiday_promotion"))).collect()]
    assert got == [1, 1, 1, 1, 0, 0, 0, 0]


# FX8 ranges
def test_fx8_range_violations(spark, tmp):
    rows = [row(price="-1", store="S1"), row(units="-2", store="S2"), row(discount="101", store="S3")]
    df = clean.coerce_numeric(clean.normalise_headers(read_sales_csv(spark, sales_csv(tmp, rows))))
    got = {r["rule"]: r["violations"] for r in quality.range_checks(df).collect()}
    assert got == {"negative_price": 1, "negative_units_sold": 1, "discount_above_100": 1}


# FX9 missing columns
@pytest.mark.parametrize("header", [
    "age,sex,cp,trestbps,chol,fbs,restecg,thalach,exang,oldpeak,slope,ca,thal,target",
    "sepal_length,sepal_width,petal_length,petal_width,species",
])
def test_fx9_missing_columns(spark, tmp, header):
    p = sales_csv(tmp, [",".join(["1"] * len(header.split(",")))], header=header)
    df = clean.normalise_headers(read_sales_csv(spark, p))
    with pytest.raises(ValueError) as err:
        quality.check_schema(df)
    assert "date" in str(err.value) and "units_sold" in str(err.value)


# FX10 price columns
def test_fx10_price_detection(spark):
    base = spark.createDataFrame([(2.0, 3.0, 5.0)], "units_sold double, unit_price double, price double")
    assert metrics.price_column(base, None) == "unit_price"
    r = metrics.with_revenue(base, candidates=["unit_price", "price"]).first()["revenue"]
    assert r == 6.0
    none = spark.createDataFrame([(2.0,)], "units_sold double")
    assert metrics.with_revenue(none, fallback="units").first()["revenue"] == 2.0
    assert metrics.with_revenue(none, fallback="zero").first()["revenue"] == 0.0


# FX11 run log: lines of two runs, lines outside any run, banner text
LOG = """shop tool ready
2025-01-02 03:04:05,100 | INFO | ready for uploads
2025-01-02 03:04:06,000 | INFO | RUN_ID=aaaa1111 | reading file
2025-01-02 03:04:06,250 | INFO | RUN_ID=aaaa1111 | dropping copies
2025-01-03 00:00:01,250 | WARNING | RUN_ID=aaaa1111 | done late
2025-01-02 03:05:00,000 | INFO | RUN_ID=bbbb2222 | reading file
2025-01-02 03:05:01,500 | ERROR | RUN_ID=bbbb2222 | no date column
 (see manual)"""


def test_fx11_run_log(spark, tmp):
    p = os.path.join(tmp, "tool.log")
    with open(p, "w") as fh:
        fh.write(LOG + "\n")
    parsed = jobs.parse_run_log(spark.read.text(p))
    assert parsed.count() == 6
    runs = parsed.filter(F.col("run_id").isNotNull())
    d = jobs.step_durations(runs, "run_id", "ts")
    got = {(r["run_id"], r["message"]): r["duration_sec"] for r in d.collect()}
    assert got[("aaaa1111", "reading file")] == pytest.approx(0.25)
    assert got[("aaaa1111", "dropping copies")] == pytest.approx(75355.0)  # the next step is on the next day
    assert got[("aaaa1111", "done late")] is None and len(got) == 5
    alarms = jobs.window_alarm(parsed, "ts", F.col("level") == "ERROR")
    assert alarms.count() == 1


# Exact quantiles
def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for values in (rng.normal(size=4000).round(3), rng.integers(0, 5, 3000).astype(float), np.array([7.0]), np.repeat([1.0, 2.0], 2500)):
        df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)] + [(None, 0)], "v double, g int").repartition(4)
        for accuracy in (50, 1000):  # a small accuracy makes the brackets matter
            r = quantiles.exact_quantiles(df, "v", [0.05, 0.25, 0.5, 0.75, 0.95], accuracy=accuracy).first()
            assert r["n"] == len(values)
            assert [r[f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(values, [0.05, 0.25, 0.5, 0.75, 0.95])))
        for r in quantiles.exact_quantiles(df, "v", [0.25, 0.95], by=["g"], accuracy=50).collect():
            assert [r["q0"], r["q1"]] == pytest.approx(list(np.quantile(values[r["g"] :: 3], [0.25, 0.95])))
    assert "percentile(" not in clean.fence_bounds(df, "v")._jdf.queryExecution().toString().lower().replace("percentile_approx(", "")


def test_quantiles_narrow_in_rounds(spark):
    """Brackets that may hold few rows force rounds; ties, gaps and far values stay exact, and no window orders the rows."""
    import numpy as np

    rng = np.random.default_rng(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    for values in (rng.normal(size=20_000), rng.integers(0, 4, 20_000).astype(float), np.concatenate([np.full(9_000, 5.0), rng.pareto(0.3, 9_000)]), -np.abs(rng.standard_cauchy(15_000))):
        df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)] + [(None, 7)], "v double, g int").repartition(4)
        found = quantiles.exact_quantiles(df, "v", probs, accuracy=100, gathered=20)
        r = found.first()
        assert r["n"] == len(values) and [r[f"q{i}"] for i in range(6)] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
        assert "Window" not in found._jdf.queryExecution().toString()
        for r in quantiles.exact_quantiles(df, "v", [0.25, 0.95], by=["g"], accuracy=100, gathered=20).collect():
            assert [r["q0"], r["q1"]] == pytest.approx(list(np.quantile(values[r["g"] :: 2], [0.25, 0.95])), rel=1e-12)
    assert quantiles.exact_quantiles(df.where("false"), "v", [0.5]).collect() == []


# Rejected modes and degenerate histories
def test_unknown_operation_is_rejected(spark, tmp):
    p = prepare(read_sales_csv(spark, sales_csv(tmp, [row()])))
    for fn in (reports.report_document, reports.markdown_lines, reports.run_operation):
        with pytest.raises(ValueError, match="bogus"):
            fn(p, operation="bogus")
    for column in ("units_sold", "category", "region"):
        with pytest.raises(ValueError, match=column):
            reports.run_operation(p.drop(column), "business_analysis")
    texts = [r["text"] for r in reports.forecast_narrative(p).where("section = 'insight'").collect()]
    assert len(texts) == 7 and None not in texts
    assert reports.forecast_metrics(p).first()["forecast_range"] is None


# F6 / F7 / F9 / F11 text helpers
def test_text_helpers(spark):
    df = spark.createDataFrame([(7, "Peak sales months are 7, 8, 12.", 1234.5, 1000.0)],
                               "m int, t string, v double, nxt double")
    r = df.select(month_name(F.col("m")).alias("n"), month_name(F.lit(13)).alias("n13"),
                  rewrite_month_numbers(F.col("t")).alias("rw"), currency_text(F.col("v")).alias("c"),
                  currency_text(F.lit(None)).alias("c0"), forecast_range_text(F.col("nxt")).alias("rng")).first()
    assert r["n"] == "July" and r["n13"] == "13"
    assert r["rw"] == "Peak sales months are July, August."
    assert r["c"] == "₹1,234.50" and r["c0"] == "₹0.00"
    assert r["rng"] == "950 - 1050"


# FX12 job events: latest status and late data
def test_fx12_latest_status(spark):
    ev = spark.createDataFrame([
        ("j1", "QUEUED", "2026-03-10 09:30:00"), ("j1", "SUCCEEDED", "2026-03-10 09:40:00"),
        ("j1", "RUNNING", "2026-03-10 09:35:00"), ("j2", "RUNNING", "2026-03-10 09:31:00"),
        ("j2", "FAILED", "2026-03-10 09:33:00")], "job_id string, status string, updated_at string"
    ).withColumn("updated_at", F.to_timestamp("updated_at"))
    got = {r["job_id"]: r["latest_status"] for r in jobs.latest_status(ev, "job_id", "updated_at", "status").collect()}
    assert got == {"j1": "SUCCEEDED", "j2": "FAILED"}


# Reports on a tiny table
def test_business_narrative_conditionals(spark, tmp):
    rows = [row(cat="A", units="50", store="S1"), row(cat="B", units="45", store="S2"),
            row(cat="C", units="5", store="S3", reg="South")]
    p = prepare(read_sales_csv(spark, sales_csv(tmp, rows)))
    texts = [r["text"] for r in reports.business_narrative(p).orderBy("ord").collect()]
    assert texts[0] == "A contributes 50.0% of total sales."
    assert "A dominates heavily → business dependency risk." in texts
    assert "C has very low contribution → consider restructuring." in texts
    assert texts[-1] == "Focus marketing efforts on high-performing segments."
