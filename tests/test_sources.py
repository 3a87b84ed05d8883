from datetime import datetime

import pytest

from tablewright.errors import SourceError, UnsupportedFile
from tablewright.plans.settings import Upload
from tablewright.sources import guards, headers, load, sinks
from tablewright.sources.workbook import Workbook, write

ROWS = [f"INV-{i},2026-07-{i % 28 + 1:02d},{'North' if i % 2 else 'South'},{i},{i}.5" for i in range(60)]
CSV = "invoice_no,invoice_date,branch,quantity,unit_price\n" + "\n".join(ROWS) + "\n"


def read(spark, text, **options):
    content = text if isinstance(text, bytes) else text.encode()
    return load.for_upload(spark, "f.csv", content, **options).load()


def test_csv_types(spark):
    got = read(spark, CSV)
    assert got.rows == 60 and [c.detected_type for c in got.columns] == ["string", "date", "category", "integer", "float"]
    assert got.header_row == 0 and got.columns[2].sample_values == ("South", "North") and got.columns[0].unique_count == 60
    assert got.preview(2).collect()[1]["invoice_no"] == "INV-1" and got.columns_frame().count() == 5
    assert got.to_dict()["encoding"] == "utf-8" and got.size_label.endswith("KB")


@pytest.mark.parametrize("mark", [";", "\t", "|"])
def test_delimiters(spark, mark):
    got = read(spark, CSV.replace(",", mark))
    assert got.details["delimiter"] == mark and len(got.columns) == 5


@pytest.mark.parametrize(("encoding", "text"), [("cp1252", "name,n\nCafé,1\nB,2\n"), ("utf-8-sig", "name,n\nCafé,1\nB,2\n"), ("utf-16", "name,n\nCafé,1\nB,2\n")])
def test_encodings(spark, encoding, text):
    got = read(spark, text.encode(encoding))
    assert [r["name"] for r in got.table.orderBy("_source_row").collect()] == ["Café", "B"]


def test_titles_blank_headers_and_short_rows(spark):
    got = read(spark, "Report of July,,,\n,,,\n" + "a,b,c,\n1,2,3,\n4,,6,\n7\n")
    assert got.table.columns == ["_source_row", "a", "b", "c"] and got.dropped == ("unnamed_4",) and got.header_row is not None
    assert [tuple(r) for r in got.table.orderBy("_source_row").collect()] == [(1, "1", "2", "3"), (2, "4", None, "6"), (3, "7", None, None)]


def test_wide_row_is_an_error(spark):
    with pytest.raises(SourceError):
        read(spark, "a,b\n" + "1,2\n" * 300 + "1,,,4\n")


def test_header_only_and_no_header(spark):
    assert read(spark, "a,b\n").rows == 0
    assert read(spark, "1,2\n3,4\n", header=None).table.columns == ["_source_row", "column_1", "column_2"]


def test_find_header():
    assert headers.find([["Title", None, None], [None, None, None], ["a", "b", "c"], ["1", "2", "3"]]) == 2
    assert headers.find([["1", "2"], ["3", "4"]]) == 0 and headers.is_label("Qty") and not headers.is_label("12%") and not headers.is_label("2026-01-02")


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    sales = [(f"I{i}", datetime(2026, 7, 1), i, i + 0.5, True) for i in range(30)]
    write(path, {"Sales": (["id", "day", "n", "price", "ok"], sales), "Stock": (["Report"], [[None], ["sku", "qty"], ["S1", 4]]), "Empty": ([], [])})
    source = load.Excel.from_path(spark, path)
    assert source.sheets() == ("Sales", "Stock", "Empty")
    got = source.load()
    assert got.rows == 30 and [c.detected_type for c in got.columns] == ["string", "date", "integer", "float", "boolean"]
    assert got.table.orderBy("_source_row").first()["day"] == "2026-07-01"
    assert set(source.load_all()) == {"Sales", "Stock"}
    with pytest.raises(SourceError):
        load.Excel.from_path(spark, path, sheet="No").load()
    assert next(Workbook(open(path, "rb").read()).rows("Stock")) == ["Report"]
    sinks.to_workbook({"A": got.table}, str(tmp_path / "c.xlsx"))
    assert load.Excel.from_path(spark, str(tmp_path / "c.xlsx")).load().rows == 30


def test_sql(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string").createOrReplaceTempView("sales_view")
    assert load.create("sql", spark, table="sales_view").load().rows == 2
    assert load.Sql(spark, query="select * from sales_view where n = :n", params={"n": 2}).load().rows == 1
    for bad in ("drop table x", "select 1; select 2", "with a as (select 1) insert into b select * from a"):
        with pytest.raises(SourceError):
            guards.check_query(bad)
    assert guards.check_query("select 'drop it' as update_note, replace(s, 'a', 'b') from t") and guards.redact("jdbc:x://u:pw@h/d") == "jdbc:x://u:***@h/d"
    for options in ({}, {"table": "a", "query": "select 1"}, {"table": "a; b"}):
        with pytest.raises(SourceError):
            load.Sql(spark, **options)


def test_sheets(spark):
    class Client:
        def worksheets(self):
            return ["Targets"]

        def values(self, title):
            return [["Targets", "", ""], [], ["branch", "month", "target"], ["North", "2026-07", "10"], ["South", "", "5"]]

    got = load.Sheets(spark, Client()).load()
    assert got.rows == 2 and got.table.columns[1:] == ["branch", "month", "target"]
    with pytest.raises(SourceError):
        load.Sheets(spark, Client(), worksheet="No").load()


def test_guards():
    assert guards.safe_name("../../x;rm.csv") == "x_rm.csv" and guards.safe_name("C:\\d\\\u0007Caf\u00e9 (1).csv.") == "Caf\u00e9 (1).csv" and len(guards.safe_name("x" * 900)) == 200
    assert guards.redact("a password = hidden; token:x&k=1") == "a password = ***; token:***&k=1"
    for name, content in (("a.exe", b"x"), ("a.csv", b""), ("a.csv", b"MZ.."), ("a.csv", b"a\0b"), ("a.xlsx", b"text"), ("...", b"x")):
        with pytest.raises(UnsupportedFile):
            guards.check_upload(name, content)
    with pytest.raises(UnsupportedFile):
        guards.check_size("a", 3 << 20, Upload(max_file_size_mb=1))
    with pytest.raises(SourceError):
        load.create("none")


def test_delimited_paths(spark, tmp_path):
    """Files of a folder, of which the driver reads the first lines of one."""
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"part-{k}.csv").write_text("".join(f"{k}-{i};\u00e9x{i};{i}\n" for i in range(400)), encoding="utf-8")
    got = load.create("delimited_path", spark, str(folder), header=None).load()
    assert got.rows == 1200 and got.details["delimiter"] == ";" and got.details["encoding"] == "utf-8"
    assert sorted(r["_source_row"] for r in got.table.collect()) == list(range(1, 1201)) and {r["column_2"] for r in got.table.collect()} == {f"\u00e9x{i}" for i in range(400)}
    one = tmp_path / "one.csv"
    one.write_text(CSV, encoding="cp1252")
    got = load.DelimitedPath(spark, str(one)).load()
    assert got.rows == 60 and [c.detected_type for c in got.columns] == ["string", "date", "category", "integer", "float"]
    one.write_text("a,b\n" + "1,2\n" * 300 + "1,,,4\n")
    for path in (str(one), str(tmp_path / "nowhere")):
        with pytest.raises(SourceError):
            load.DelimitedPath(spark, path).load()


def test_registry(spark):
    @load.source("own", ".own")
    class Own(load.Source):
        def read(self):
            return spark.createDataFrame([(1, "a")], "_source_row long, n string"), True, {"by": "hand"}

    try:
        assert load.kind_class("own") is Own and load.kinds()["own"] == (".own",) and "xlsx" in load.kinds()
        got = load.create("own", spark, "x").load()
        assert got.rows == 1 and got.to_dict()["by"] == "hand" and guards.sha256(b"") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    finally:
        del load.REGISTRY["own"], load.ENDINGS[".own"]


def test_queries_of_foreign_dialects(spark):
    assert guards.check_query("select top 5 [a b] from t", foreign=True)
    for bad in ("select [a] from t; drop table t", "select 1 insert into t", "show tables", "with a as (select 1) delete from b"):
        with pytest.raises(SourceError):
            guards.check_query(bad, foreign=True)


def test_parquet_and_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    sinks.to_parquet(df, str(tmp_path / "p"))
    assert load.Parquet(spark, str(tmp_path / "p")).load().rows == 1
    sinks.to_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1
