"""Dates by shape against Python's own parser and against the layouts tried one after the other."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from oracle_harness import SF_SMALL
from tillgrid.config import DATE_FORMATS
from tillgrid.functions import dates
from tillgrid.operators import clean
from tillgrid.plans.catalog import QUERIES

PYTHON = {"yyyy": "%Y", "yy": "%y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "M": "%m", "dd": "%d", "d": "%d"}


def written(day: date, layout: str, padded: bool) -> str:
    out = ""
    for part in dates.layout_fields(layout):
        text = day.strftime(PYTHON[part]) if part in PYTHON else part
        out += text.lstrip("0") if part in ("d", "M") and not padded else text
    return out


def parsed(spark, texts, formats=None):
    rows = clean.parse_dates(spark.createDataFrame(list(enumerate(texts)), "i int, date string"), "date", formats).collect()
    return [r["date"] for r in sorted(rows, key=lambda r: r["i"])]


def test_every_layout_round_trips(spark):
    rng = random.Random(3)
    days = [date(1969, 1, 1), date(2068, 12, 31), date(2000, 2, 29), date(1996, 2, 29), date(2023, 5, 9)]
    days += [date(1970, 1, 1) + timedelta(days=rng.randrange(30_000)) for _ in range(40)]
    cells = [(written(d, layout, padded), d) for layout in DATE_FORMATS for d in days for padded in (True, False)]
    assert parsed(spark, [c for c, _ in cells]) == [d for _, d in cells]
    upper = [(c.upper(), d) for c, d in cells] + [(f"  {c.lower()} ", d) for c, d in cells]
    assert parsed(spark, [c for c, _ in upper]) == [d for _, d in upper]


def test_bad_cells_are_null(spark):
    bad = [None, "", " ", "bad", "31/02/1996", "29/02/1900", "29.2.2023", "0/1/2020", "1/0/2020", "1/13/2020", "32/1/2020", "2020-13-01", "2020-00-10", "0000-01-01",
           "1//2020", "1/1/20201", "20201301", "1 Foo 2020", "1 Janu 2020", "Jan 1 2020", "1-1/2020", "٣/١/٢٠٢٠", "1/1/2020x", "x" * 10_000, "9/9/9999999", "a/a/aaaa", "99/99/9999",
           "11:30", "- - -"]
    assert parsed(spark, bad) == [None] * len(bad)


def test_equals_layouts_tried_in_order(spark):
    rng = random.Random(9)
    cells = []
    for _ in range(600):
        layout = rng.choice(DATE_FORMATS)
        text = written(date(1970, 1, 1) + timedelta(days=rng.randrange(30_000)), layout, rng.random() < 0.5)
        cells.append(text)
        i = rng.randrange(len(text))
        if not (rng.random() < 0.3 and text[i].isdigit() and text[i - 1 : i] == ""):
            cells.append(text[:i] + rng.choice("0123456789 /.-J") + text[i + 1 :])
    df = spark.createDataFrame([(c,) for c in cells], "t string").withColumn("text", dates.date_text(F.col("t")))
    both = dates.with_day_by_shape(df.withColumn("tried", dates.parse_date_text(F.col("text"))), F.col("text"), "day")
    rows = both.collect()
    differ = [(r["t"], r["tried"], r["day"]) for r in rows if r["tried"] != r["day"]]
    assert differ == []
    assert sum(r["day"] is None for r in rows) > 50


def test_layouts_that_share_a_shape_keep_their_order(spark):
    assert parsed(spark, ["13/2/2020", "2/13/2020", "3/4/2020", "13/13/2020"], ["d/M/yyyy", "M/d/yyyy"]) == [date(2020, 2, 13), date(2020, 2, 13), date(2020, 4, 3), None]
    assert parsed(spark, ["13/2/2020", "2/13/2020", "3/4/2020"], ["M/d/yyyy", "d/M/yyyy"]) == [date(2020, 2, 13), date(2020, 2, 13), date(2020, 3, 4)]


def test_other_layouts_are_tried(spark):
    assert dates.shape_table(["EEE d/M/yyyy"]) is None
    assert parsed(spark, ["2020-W05", "2020 045"], ["yyyy DDD"]) == [None, date(2020, 2, 14)]


def test_shapes_name_their_layout_only():
    table = dates.shape_table(DATE_FORMATS)
    assert all(len(places) == 1 for places in table.values())
    assert table["99/9/9999"] == [{"m_name": 0, "d_at": 1, "d_width": 2, "m_at": 4, "m_width": 1, "y_at": 6, "y_width": 4}]
    assert max(map(len, table)) <= dates.LONGEST_CELL


def test_times_and_zones(spark):
    text = ["3/4/2020 13:05", "2020-04-03T13:05:00Z", "2020-04-03 13:05:00.123 +02:00", "3 Apr 2020 1:05 PM", "3 Apr 2020 99:99:99:99"]
    assert parsed(spark, text)[:4] == [date(2020, 4, 3)] * 4


@pytest.mark.parametrize("name", ["dates_parsed", "rejected_rows"])
def test_no_layout_is_tried(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString().lower()
    assert "timestamp" not in plan.replace("timestamp_ntz", "")
