import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablewright.errors import CalculationFailed, ConfigError, SinkError
from tablewright.operators import clean, exceptions, measures, outliers, profile, rows, samples, worktime
from tablewright.plans.contracts import load_catalog
from tablewright.plans.settings import Anomaly, Calendar, Cleaning, Settings, settings
from tablewright.sources import load, sinks
from tablewright.streaming import checks

from .test_validate import HEADER, SALES


def test_numbered_and_repeats(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")))
    out = rows.repeats(rows.numbered(df), [F.col("k")], "again").orderBy("_source_row").collect()
    assert [r["_source_row"] for r in out] == list(range(1, 1001)) and [r["id"] for r in out] == list(range(1000))
    seen = set()
    for r in out:
        assert r["again"] == (r["k"] in seen)
        seen.add(r["k"])


@pytest.mark.parametrize("shown", [100_000, 0])
def test_repeats_split_hot_keys_and_rows_outside(spark, monkeypatch, shown):
    """A key on a third of the rows, and half of the rows outside: no partition of the marked rows is far over the mean."""
    monkeypatch.setattr(rows, "SHOWN", shown)
    monkeypatch.setattr(rows, "HOT_ROWS", 100)
    n = 24_000
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        df = spark.range(1, n + 1, 1, 6).select(F.col("id").alias("_source_row"), F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") / 2).cast("long") + 100).alias("k"), (F.col("id") % 2 == 0).alias("use"))
        for among in (None, F.col("use")):
            out = rows.repeats(df, [F.col("k")], "again", among=among).withColumn("pid", F.spark_partition_id()).collect()
            seen, sizes = set(), {}
            for r in sorted(out, key=lambda r: r["_source_row"]):
                used = among is None or r["use"]
                assert r["again"] == (used and r["k"] in seen)
                seen |= {r["k"]} if used else set()
                sizes[r["pid"]] = sizes.get(r["pid"], 0) + 1
            assert len(out) == n and max(sizes.values()) < 2 * n / len(sizes), sizes
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_numbers_of_groups_that_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(i % 40, float(i % 7)) for i in range(800)], "g int, v double")
    want = sorted(map(tuple, outliers.iqr(df, "v", ["g"]).collect()))
    monkeypatch.setattr(rows, "SHOWN", 3)
    assert sorted(map(tuple, outliers.iqr(df, "v", ["g"]).collect())) == want


def test_samples(spark):
    df = spark.range(0, 40_000, 1, 4).select(samples.poisson(3.5, 1).alias("p"), samples.lognormal(1.0, 0.5, 2).alias("x"), samples.whole_above(F.lit(2.1)).alias("c"))
    got = df.agg(F.avg("p").alias("p"), F.var_pop("p").alias("v"), F.avg(F.log("x")).alias("m"), F.stddev("x").alias("s"), F.max("c").alias("c")).first()
    assert got["p"] == pytest.approx(3.5, abs=0.05) and got["v"] == pytest.approx(3.5, abs=0.15) and got["m"] == pytest.approx(1.0, abs=0.02) and got["c"] == 3
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(1, 6)], "_source_row long, n string")
    extra = spark.createDataFrame([(1, "a"), (3, "c"), (3, "b"), (9, "z")], "at long, n string")
    out = samples.insert(rows, extra, "at").orderBy("_source_row").collect()
    assert [r["n"] for r in out] == ["a", "r1", "r2", "b", "c", "r3", "r4", "r5", "z"] and [r["_source_row"] for r in out] == list(range(1, 10))


def test_rows_in_order_have_one_number_each(spark):
    """More rows than a sort samples for its bounds, which differ from run to run; nulls come last, as in SQL."""
    n = 30_000
    df = spark.range(0, n, 1, 3).select((F.col("id") * 7919 % n).alias("id")).withColumn("k", F.when(F.col("id") % 5 > 0, F.col("id") % 50))
    got = sorted((r["_source_row"], r["id"]) for r in samples.in_order(df, ["k", "id"]).collect())
    want = sorted(range(n), key=lambda i: (i % 5 == 0, i % 50 if i % 5 else 0, i))
    assert got == list(enumerate(want, start=1))


def test_plug_ins(spark, tmp_path):
    @outliers.detector("over")
    def over(df, value, by, settings):
        return df.withColumn("is_anomaly", F.col(value) > 2)

    @sinks.sink("count")
    def count(df, path):
        (tmp_path / path).write_text(str(df.count()))

    try:
        df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "t int, v double")
        assert [r["is_anomaly"] for r in outliers.detect(df, "v", "t", method="over").orderBy("t").collect()] == [False, True]
        sinks.write("count", df, "n.txt")
        assert (tmp_path / "n.txt").read_text() == "2"
        for kind in ("orc", "json", "parquet"):
            sinks.write(kind, df, str(tmp_path / kind))
            assert load.create(kind, spark, str(tmp_path / kind)).load().rows == 2
        with pytest.raises(SinkError):
            sinks.write("fax", df, "x")
    finally:
        del outliers.METHODS["over"], sinks.WRITERS["count"]


def test_steps_of_single_columns(spark):
    rule = load_catalog()["sales"].columns["quantity"]
    df = spark.createDataFrame([(" a   b ", "N/A", " NORTH", "1,200")], "a string, b string, c string, d string")
    got = df.select(clean.trimmed(F.col("a")), clean.without_placeholders(F.col("b"), ("n/a",)), clean.spelled_as(F.col("c"), ("North",)), clean.typed_as(F.col("d"), rule, df.schema["d"].dataType)).first()
    assert tuple(got) == ("a b", None, "North", 1200.0)


def test_workspace(tmp_path, capsys):
    import logging

    from tablewright.errors import FeatureUnavailable
    from tablewright.plans.workspace import Workspace, stage, start_logging

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "tablewright.yaml").write_text("")
    own = Workspace(settings({"features": {"email": True}, "holidays": "days.csv"}), {"SMTP_HOST": "h"}, tmp_path / "a" / "b")
    assert own.home == tmp_path.resolve() and own.path("logs") == own.home / "logs" and own.holidays == own.home / "days.csv" and own.locate("/x") == own.locate("/x").resolve()
    assert own.folder("reports").is_dir() and own.database.startswith("sqlite:///") and own.features() == {"email": False, "ai_analysis": False, "google_sheets": False}
    named = Workspace(own.settings, {"SMTP_HOST": "h", "SMTP_FROM": "f", "DATABASE_URL": "db://x", "TABLEWRIGHT_HOME": str(tmp_path / "a")}, tmp_path)
    named.need("email")
    assert named.features()["email"] and named.database == "db://x" and named.home == (tmp_path / "a").resolve()
    for feature in ("email", "ai_analysis"):
        with pytest.raises(FeatureUnavailable):
            own.need(feature)
    with pytest.raises(ConfigError):
        own.path("nowhere")
    for _ in range(2):
        log = start_logging(tmp_path / "logs", console=False)
    assert len(log.handlers) == 1
    log.info("password=%s of db://user:%s@host", "hidden1", "hidden2")
    with pytest.raises(ZeroDivisionError), stage("dividing") as took:
        1 / 0  # noqa: B018
    assert took.seconds == took.seconds >= 0
    for handler in logging.getLogger("tablewright").handlers:
        handler.flush()
    text = (tmp_path / "logs" / "tablewright.log").read_text()
    assert text.count("password=***") == 1 and "hidden" not in text and "dividing took" in text
    start_logging(console=False)


def working_seconds(a, b, calendar, off):
    total, day = 0, a.date()
    while day <= b.date():
        if calendar.days[day.weekday()] and day not in off:
            opens, closes = dt.datetime.combine(day, calendar.start), dt.datetime.combine(day, calendar.end)
            total += max(0, (min(b, closes) - max(a, opens)).total_seconds())
        day += dt.timedelta(days=1)
    return total


def test_turnaround_and_its_inverse(spark):
    rng, calendar, off = random.Random(4), Calendar(), {dt.date(2026, 1, 26)}
    data = []
    for i in range(200):
        a = dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 60))
        data.append((i, a, a + dt.timedelta(minutes=rng.randrange(60 * 24 * 12))))
    data += [(900, None, dt.datetime(2026, 1, 1)), (901, dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 1))]
    df = spark.createDataFrame(data, "i int, a timestamp_ntz, b timestamp_ntz")
    holidays = spark.createDataFrame([(dt.date(2026, 1, 26),)], "holiday_date date")
    got = worktime.turnaround(df, "a", "b", calendar, holidays)
    back = worktime.add_hours(got.where("tat_hours > 0"), "a", "tat_hours", calendar, holidays).collect()
    for r in got.collect():
        if r["i"] >= 900:
            assert r["tat_hours"] is None
        else:
            assert r["tat_hours"] * 3600 == pytest.approx(working_seconds(r["a"], r["b"], calendar, off))
    for r in back:
        assert working_seconds(r["a"], r["due_at"], calendar, off) == pytest.approx(r["tat_hours"] * 3600)
    in_time = worktime.with_sla(got.withColumn("priority", F.lit("High")))
    sla = in_time.agg(worktime.compliance(in_time).alias("x")).first()
    assert 0 <= sla["x"] <= 100


def test_outliers(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([10.0, 11.0, 9.0, 10.0, 100.0, 10.0, 11.0, None, 0.0, 10.0])] + [("b", 1, 1.0), ("b", 2, 50.0)], "g string, i int, v double")
    hit = lambda out: {(r["g"], r["i"]) for r in out.where("is_anomaly").collect()}
    assert hit(outliers.detect(df, "v", "i", ["g"])) == {("a", 4), ("a", 8)}
    assert hit(outliers.iqr(df, "v", ["g"], exact=False)) == {("a", 4), ("a", 8)}
    assert hit(outliers.detect(df, "v", "i", ["g"], Anomaly(method="zscore", zscore_threshold=2))) == {("a", 4)}
    assert ("a", 5) in hit(outliers.detect(df, "v", "i", ["g"], Anomaly(method="rolling", min_observations=3)))
    assert hit(outliers.detect(df, "v", "i", ["g"], Anomaly(method="pct_change"))) == {("a", 4), ("b", 2)}
    assert outliers.zscore(df.where("g = 'a'"), "v").count() == 10


def test_measures(spark):
    df = spark.createDataFrame([("i1", 2, 10.0, 0.0, 4.0, "x"), ("i1", 1, 20.0, 50.0, 4.0, "y"), ("i2", 1, 0.0, None, 4.0, "x")], "invoice_no string, quantity int, unit_price double, discount_pct double, cost_price double, branch string")
    row = measures.calculate(df, ["total_sales", "net_sales", "order_count", "gross_profit", "avg_margin_pct"]).first()
    assert (row["total_sales"], row["net_sales"], row["order_count"], row["gross_profit"]) == (40.0, 30.0, 2, 14.0)
    assert row["avg_margin_pct"] == pytest.approx((12 / 20 * 100 + 6 / 10 * 100) / 2)
    assert measures.calculate(df, ["units_sold"], ["branch"], total=True).count() == 3
    for codes in (["nope"], ["stock_days"]):
        with pytest.raises((CalculationFailed, Exception)):
            measures.calculate(df, codes)
    with pytest.raises(CalculationFailed):
        measures.measure("units_sold", "sales", "count")(lambda: F.sum("quantity"))
    assert {m().group for m in measures.REGISTRY.values()} == {"sales", "inventory", "margin", "operations"} and len(measures.REGISTRY) == 22
    assert [r["exceptions"] for r in exceptions.sales(df).collect()] == [[], ["high_discount"], ["zero_price"]]


def test_orders_exceptions(spark):
    df = spark.createDataFrame([(100_000.0, "open", 25.0), (1.0, "completed", 99.0), (None, "in_progress", 3.0)], "order_value double, status string, age_hours double")
    assert [r["exceptions"] for r in exceptions.orders(df).collect()] == [["high_value", "long_pending"], [], []]


def test_profile_types(spark):
    df = spark.createDataFrame([(i, None, dt.datetime(2026, 1, 1, i % 24), dt.date(2026, 1, 1), i % 2 == 0, float(i), f"{i},5") for i in range(30)], "n long, e string, t timestamp, d date, b boolean, x double, s string")
    assert [p.detected_type for p in profile.profile(df)] == ["integer", "empty", "datetime", "date", "boolean", "integer", "integer"]
    assert profile.profile(df, approximate=True)[0].unique_count == pytest.approx(30, rel=0.1) and profile.empty_rows(df) == 0


def test_settings():
    got = settings({"validation": {"dayfirst": False}, "calendar": {"start": 510, "end": "17:30"}, "upload": {"allowed_extensions": ["CSV"]}})
    assert not got.validation.dayfirst and got.calendar.day_seconds == 9 * 3600 and got.upload.allowed_extensions == (".csv",) and isinstance(got, Settings)
    for bad in ({"odd": 1}, {"validation": {"odd": 1}}, {"cleaning": {"category_case": "x"}}, {"calendar": {"start": "25:00"}}, {"anomaly": {"method": "x"}}, {"calendar": {"start": "18:00"}}):
        with pytest.raises(ConfigError):
            settings(bad)
    assert Cleaning(placeholder_values=(" N/A ",)).placeholder_values == ("n/a",)


def test_too_large_a_sheet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 3)
    with pytest.raises(SinkError):
        sinks.to_workbook({"a": spark.range(10).toDF("n")}, str(tmp_path / "x.xlsx"))


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    stamped = [(*r, dt.datetime(2026, 7, 1, 10, i)) for i, r in enumerate(SALES)]
    spark.createDataFrame(stamped, ", ".join(f"{h} string" for h in HEADER) + ", ts timestamp").coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    found = checks.annotate(checks.without_repeats(stream, "ts", ["invoice_no", "sku"]), load_catalog(), "sales")
    query = found.writeStream.format("memory").queryName("checked").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r["invoice_no"]: r["_failed"] for r in spark.table("checked").collect()}
    assert len(got) == 8 and got["INV-6"] == ["negative_values(quantity)"] and got["INV-4"] == ["invalid_dates(invoice_date)"] and got["INV-2"] == []
    windows = checks.failures(checks.annotate(spark.read.parquet(source), load_catalog(), "sales"), "ts")
    assert sum(r["n"] for r in windows.collect()) == 5


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and callable(entry.entry)
