import pytest

from tablewright.errors import ConfigError, ValidationFailed
from tablewright.functions import names
from tablewright.operators.validate import Validator
from tablewright.plans.contracts import Catalog, contract, load_catalog, weights
from tablewright.plans.settings import Validation

HEADER = ["invoice_no", "invoice_date", "branch", "category", "sku", "quantity", "unit_price", "discount_pct"]
SALES = [
    ("INV-1", "2026-07-01", "North", "Tea", "S1", "2", "100", "0"),
    ("INV-2", "2026-07-01", "South", "Rice", "S2", "1", "200", "5"),
    ("INV-3", "2026-07-02", "North", "Tea", "S3", "3", "50", "0"),
    ("INV-3", "2026-07-02", "North", "Tea", "S3", "3", "50", "0"),
    ("INV-4", "2026-07-32", "South", "Rice", "S4", "1", "80", "0"),
    ("INV-5", "2026-07-03", " ", "Tea", "S5", "1", "80", "0"),
    ("INV-6", "2026-07-03", "North", "Tea", "S6", "-2", "80", "0"),
    ("INV-7", "2026-07-03", "North", "Tea", "S7", "2", "abc", "0"),
    ("INV-8", "2026-07-03", "North", "Tea", "S8", "2", "80", "150"),
    ("INV-1", "2026-07-04", "North", "Tea", "S1", "9", "70", "0"),
]


@pytest.fixture(scope="module")
def catalog():
    return load_catalog()


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, HEADER).coalesce(1)


def test_worked_example(sales, catalog):
    report = Validator(catalog).validate(sales, "sales")
    got = {d.name: (d.checked, d.failed, d.score) for d in report.parts}
    assert got["completeness"] == (70, 1, 98.57)
    assert got["validity"] == (40, 2, 95.0)
    assert got["uniqueness"] == (10, 2, 80.0)
    assert got["consistency"] == (29, 2, 93.1)
    assert got["conformity"][2] == 100.0
    assert (report.score, report.invalid, report.valid, report.status) == (93.3, 7, 3, "PASSED WITH WARNINGS")
    assert [r["_source_row"] for r in report.invalid_rows().orderBy("_source_row").collect()] == [4, 5, 6, 7, 8, 9, 10]
    assert report.metrics["duplicate_pct"] == 20.0 and report.metrics["invalid_dates_pct"] == 10.0 and report.metrics["missing_values_pct"] == 1.43
    issues = [(r["row"], r["check"], r["value"]) for r in report.issues().collect()]
    assert (5, "invalid_dates", "2026-07-32") in issues and len(issues) == 7
    assert [r["row"] for r in report.issues(3).collect()] == sorted(r["row"] for r in report.issues(3).collect())
    by = {r.ordinal: r.name for r in report.results}
    assert {by[k]: v for k, v in report.samples().items()}["duplicate_keys"] == [10]
    report.raise_if_blocking()
    assert "93.3" in report.text() and report.to_dict()["quality_score"] == 93.3
    assert report.dimensions_frame().count() == 5 and report.checks_frame().count() == len(report.results)


def test_renamed_headers_give_the_same_score(sales, catalog):
    renamed = sales.toDF("Invoice No.", "invoice_date", " BRANCH ", "category", "sku", "Qty", "Price", "Discount %")
    report = Validator(catalog).validate(renamed, "sales")
    assert report.score == 93.3 and report.mapping["quantity"] == "Qty"


def test_missing_column_blocks(sales, catalog):
    report = Validator(catalog).validate(sales.drop("unit_price"), "sales")
    assert {d.name: d.score for d in report.parts}["conformity"] == 85.71
    with pytest.raises(ValidationFailed):
        report.raise_if_blocking()


def test_empty_table_blocks(sales, catalog):
    report = Validator(catalog).validate(sales.limit(0), "sales")
    assert report.total == 0 and report.status == "FAILED"


def test_strict_contract_counts_extra_columns(sales, catalog):
    strict = Catalog({"s": contract({"allow_unexpected_columns": False, "columns": {n: {"type": "string"} for n in HEADER}})}, catalog.weights)
    from pyspark.sql import functions as F

    report = Validator(strict).validate(sales.withColumn("more", F.lit(1)), "s")
    [result] = [r for r in report.results if r.name == "unexpected_columns"]
    assert (result.severity, result.checked, result.failed) == ("error", 9, 1)


def test_orders(spark, catalog):
    rows = [
        ("R1", "N", "IT", "High", "2026-07-01 09:00", "2026-07-01 10:00", "open"),
        ("R2", "N", "IT", " critical", "02/07/2026 09:00", "2026-07-01 10:00", "open"),
        ("R3", "N", "IT", "urgent", "2026-07-01 09:00", None, "open"),
        ("R4", "N", "IT", "low", "2026-07-01 09:00", "2026-07-03 10:00", "completed"),
    ]
    columns = ["request_id", "branch", "department", "priority", "created_at", "completed_at", "status"]
    report = Validator(catalog).validate(spark.createDataFrame(rows, columns).coalesce(1), "orders")
    got = {(r.name, r.column): (r.checked, r.failed, r.ordinal) for r in report.results}
    assert got["invalid_categories", "priority"][:2] == (4, 1)
    assert got["consistency_rule", "completed_at"][:2] == (3, 1)
    assert report.samples()[got["consistency_rule", "completed_at"][2]] == [2]
    assert report.examples(got["invalid_categories", "priority"][2]) == ["urgent"]


def test_hot_key_and_all_null_rows(spark, catalog):
    rows = [(None,) * 8] * 3 + [SALES[0]] * 5
    schema = ", ".join(f"{n} string" for n in HEADER)
    report = Validator(catalog, Validation(duplicate_check=True)).validate(spark.createDataFrame(rows, schema).coalesce(1), "sales")
    got = {r.name: r.failed for r in report.results if r.column is None}
    assert got["empty_rows"] == 3 and got["duplicate_rows"] == 6 and got["duplicate_keys"] == 0


def test_names(catalog):
    pairs = {"Invoice No.": "invoice_no", "  Unit Price ": "unit_price", "Discount %": "discount_pct", "unitPrice": "unit_price", "Sales & Returns": "sales_and_returns", "Bill #": "bill_no", "***": "column"}
    assert {k: names.standard(k) for k in pairs} == pairs
    assert names.distinct(["qty", "qty_2", "qty"]) == ["qty", "qty_2", "qty_3"]
    found = names.match(["Invoice No", "Date", "Qty", "Price", "Remarks"], catalog["sales"])
    assert found.actual == {"invoice_no": "Invoice No", "invoice_date": "Date", "quantity": "Qty", "unit_price": "Price"}
    assert set(found.missing) == {"branch", "category", "sku"} and found.extra == ("Remarks",)
    assert names.guess(HEADER, catalog.contracts) == "sales" and names.guess(["x"], catalog.contracts) is None


def test_bad_contracts():
    for bad in ({"columns": {"a": {"type": "nope"}}}, {"columns": {}, "business_key": ["a"]}, {"odd": 1}, {"columns": {"a": {"type": "float", "min": 2, "max": 1}}}):
        with pytest.raises(ConfigError):
            contract(bad)
    with pytest.raises(ConfigError):
        weights({"completeness": 1})
