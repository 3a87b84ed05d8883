from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.functions import values


def test_numbers(spark):
    texts = ["1,200.50", "12%", " 7 ", "(10)", "₹ 99", "abc", None, "", "1e5", "5d", "nan", "(5)%", "(-5)", ".5", "+5", "inf"]
    c = values.number(F.col("t"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", c.value.alias("v"), c.blank.alias("b"), c.invalid.alias("x")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [1200.5, 12, 7, -10, 99, None, None, None, 1e5, None, None, -5, None, 0.5, 5, float("inf")]
    assert [i for i, r in enumerate(rows) if r["b"]] == [6, 7] and [i for i, r in enumerate(rows) if r["x"]] == [5, 9, 10, 12]


DATES = {
    "2026-07-01": "2026-07-01", "01/08/2026": "2026-08-01", "2026-02-30": None, "31/13/2026": None, "TBD": None, "2026-07-01 08:30": "2026-07-01 08:30:00",
    "2026": "2026-01-01", "20260701": "2026-07-01", "2026-07": "2026-07-01", "2026-7-1": "2026-07-01", "2026/07/01": "2026-07-01", "1 Jul 2026": "2026-07-01",
    "July 1, 2026": "2026-07-01", "01.08.2026": "2026-08-01", "01-08-26": "2026-08-01", "1/8/2026 5:30 PM": "2026-08-01 17:30:00", "01/13/2026": "2026-01-13",
    "10:30": None, "today": None, "1 Foo 2026": None, "2026-07-01T10:00:05": "2026-07-01 10:00:05", "12/08/2026 12:05 am": "2026-08-12 00:05:00",
}


def test_dates(spark):
    c = values.date(F.col("t"), time=True)
    rows = spark.createDataFrame([(t,) for t in DATES], "t string").select("t", c.value.alias("v"), c.invalid.alias("x")).collect()
    got = {r["t"]: r["v"] for r in rows}
    assert got == {t: v and datetime.fromisoformat(v) for t, v in DATES.items()}
    assert all(r["x"] == (r["v"] is None) for r in rows)


@pytest.mark.parametrize(("text", "expected"), [("01/08/2026", "2026-01-08"), ("13/01/2026", "2026-01-13")])
def test_month_first(spark, text, expected):
    [row] = spark.createDataFrame([(text,)], "t string").select(values.date(F.col("t"), dayfirst=False).value.alias("v")).collect()
    assert str(row["v"]) == expected


def test_keys_and_case(spark):
    df = spark.createDataFrame([("  Navi \t MUMBAI ", "o'neil van-der"), ("Straße", "x"), (" a\xa0", "ÉCOLE")], "a string, b string")
    rows = df.select(values.key(F.col("a")).alias("k"), values.title(F.col("b")).alias("t"), values.flat_case(F.col("b")).alias("f")).collect()
    assert [r["k"] for r in rows] == ["navi mumbai", "strasse", "a"]
    assert [r["t"] for r in rows] == ["O'Neil Van-Der", "X", "École"] and [r["f"] for r in rows] == [True, True, True]
