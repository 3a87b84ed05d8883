import pytest

from tablewright.operators.clean import Cleaner, modal_spellings
from tablewright.operators.validate import Validator
from tablewright.plans.contracts import load_catalog
from tablewright.plans.settings import Cleaning

from .test_validate import HEADER, SALES


@pytest.fixture(scope="module")
def catalog():
    return load_catalog()


def test_worked_example(spark, catalog):
    out = Cleaner(catalog).clean(spark.createDataFrame(SALES, HEADER).coalesce(1), "sales")
    reasons = {r["_source_row"]: r["_reason"] for r in out.quarantine.collect()}
    assert reasons == {
        4: "exact duplicate of an earlier row",
        5: "invalid date in invoice_date",
        6: "missing branch",
        7: "quantity negative",
        8: "invalid float in unit_price",
        9: "discount_pct above 100",
        10: "duplicate business key (invoice_no + sku)",
    }
    rows = out.data.collect()
    assert len(rows) == 3 and sum(r["quantity"] for r in rows) == 6 and dict(out.data.dtypes)["quantity"] == "bigint"
    assert dict(out.data.dtypes)["invoice_date"] == "date" and (out.before, out.after, out.removed) == (10, 3, 7)
    assert sum(out.reasons.values()) == 7
    again = Validator(catalog).validate(out.data.drop("_source_row"), "sales")
    assert again.score == 100.0 and again.invalid == 0
    assert {r["_source_row"]: r["quantity"] for r in out.quarantine.collect()}[7] == "-2"


def test_messy(spark, catalog):
    rows = [
        ("INV-1", "01/08/2026", " Powai ", "Tea", "S1", "1,200", "₹ 10", "N/A", " a   b "),
        ("INV-2", "02/08/2026", "POWAI", "tea", "S2", "2", "(5)%", "", "-"),
        ("INV-3", "03/08/2026", "Powai", "Tea", "S3", "3", "7", "5%", None),
        ("INV-4", "04/08/2026", "powai", "TEA", "S4", "4", "8", "1", "x"),
    ]
    columns = ["Invoice No.", "Invoice Date", "Branch", "Category", "SKU", "Qty", "Price", "Discount %", "Store  Remarks"]
    out = Cleaner(catalog).clean(spark.createDataFrame(rows, columns).coalesce(1), "sales")
    data = {r["invoice_no"]: r for r in out.data.collect()}
    assert set(data) == {"INV-1", "INV-3", "INV-4"} and out.reasons == {"unit_price negative": 1}
    assert {r["branch"] for r in data.values()} == {"Powai"} and {r["category"] for r in data.values()} == {"Tea"}
    assert data["INV-1"]["quantity"] == 1200 and data["INV-1"]["unit_price"] == 10.0 and data["INV-1"]["discount_pct"] == 0.0
    assert data["INV-1"]["store_remarks"] == "a b" and data["INV-3"]["discount_pct"] == 5.0
    log = [(r["source_row"], r["column"], r["step"], r["old_value"], r["new_value"]) for r in out.changes().collect()]
    assert (1, "branch", "Trim whitespace", " Powai ", "Powai") in log
    assert (1, "discount_pct", "Placeholders → missing", "N/A", None) in log
    assert (4, "branch", "Standardise categories", "powai", "Powai") in log
    assert (1, "discount_pct", "Fill defaults", None, "0.0") in log
    assert len(out.changes(2).collect()) == 2 and out.cells == len(log)
    assert out.column_changes().count() == 9 and out.steps_frame().count() == 8 and "rows in" in out.text()


def test_policies(spark, catalog):
    df = spark.createDataFrame(SALES, HEADER).coalesce(1)
    kept = Cleaner(catalog, Cleaning(invalid_rows="keep")).clean(df, "sales")
    issues = {r["_source_row"]: r["_dq_issues"] for r in kept.data.collect()}
    assert len(issues) == 9 and issues[1] is None and issues[7] == "quantity negative" and kept.removed == 1
    free = Cleaner(catalog, Cleaning(duplicate_keys="keep", remove_duplicate_rows=False)).clean(df, "sales")
    assert free.after == 5
    upper = Cleaner(catalog, Cleaning(category_case="upper")).clean(df, "sales")
    assert {r["branch"] for r in upper.data.collect()} == {"NORTH", "SOUTH"}


def test_fractions_keep_the_column_double_and_empty_table(spark, catalog):
    rows = [(*SALES[0][:5], "1.5", *SALES[0][6:])]
    assert dict(Cleaner(catalog).clean(spark.createDataFrame(rows, HEADER), "sales").data.dtypes)["quantity"] == "double"
    empty = Cleaner(catalog).clean(spark.createDataFrame(rows, HEADER).limit(0), "sales")
    assert empty.after == 0 and empty.changes().count() == 0


def test_modal_spelling_ties(spark):
    df = spark.createDataFrame([("POWAI",), ("Powai",), ("powai",), ("b",), ("b",), ("B",)], "c string")
    assert {r["_k"]: r["_v"] for r in modal_spellings(df, ["c"]).collect()} == {"powai": "Powai", "b": "b"}


def test_orders_allowed(spark, catalog):
    rows = [
        ("R1", "N", "IT", " HIGH", "2026-07-01 09:00", "2026-07-01 08:00", "Open"),
        ("R2", "N", "IT", "urgent", "2026-07-01 09:00", None, "open"),
        ("R3", "N", "IT", "low", "1/8/2026 5:30 PM", None, "In_Progress"),
    ]
    columns = ["request_id", "branch", "department", "priority", "created_at", "completed_at", "status"]
    out = Cleaner(catalog).clean(spark.createDataFrame(rows, columns).coalesce(1), "orders")
    assert {r["_source_row"]: r["_reason"] for r in out.quarantine.collect()} == {1: "completed_at before created_at", 2: "priority not in allowed list"}
    [row] = out.data.collect()
    assert row["status"] == "in_progress" and str(row["created_at"]) == "2026-08-01 17:30:00"
