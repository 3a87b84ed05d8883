"""Queries over the driver's tables, one for each operator, with the SQL that must give the same rows.

Dirty text is made from the tables by the same deterministic expression on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import names, values
from tablewright.operators import exceptions, measures, outliers, profile, samples, worktime
from tablewright.operators.clean import Cleaner, modal_spellings, reason_histogram
from tablewright.operators.rows import ROW, repeats
from tablewright.operators.validate import Validator
from tablewright.plans.contracts import Catalog, contract, load_catalog, weights
from tablewright.plans.settings import Anomaly, Calendar, Cleaning, Validation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ dirty tables
#: Orders as text with planted faults; o_orderkey is the row number.
DIRTY = """
SELECT o_orderkey AS _source_row,
  CASE WHEN o_orderkey % 101 = 0 THEN 'R' || CAST(o_orderkey - 1 AS {s}) ELSE 'R' || CAST(o_orderkey AS {s}) END AS request_id,
  CASE WHEN o_orderkey % 53 = 0 THEN '  ' WHEN o_orderkey % 7 = 0 THEN 'NORTH' WHEN o_orderkey % 2 = 0 THEN ' North ' ELSE 'North' END AS branch,
  CASE WHEN o_orderkey % 59 = 0 THEN CAST(NULL AS {s}) ELSE 'D' || CAST(o_orderkey % 5 AS {s}) END AS department,
  CASE WHEN o_orderkey % 61 = 0 THEN 'urgent' WHEN o_orderkey % 3 = 0 THEN 'HIGH' WHEN o_orderkey % 3 = 1 THEN ' low' ELSE 'medium' END AS priority,
  CASE WHEN o_orderkey % 67 = 0 THEN '2026-02-30' WHEN o_orderkey % 2 = 0 THEN '2026-07-' || lpad(CAST(o_orderkey % 28 + 1 AS {s}), 2, '0')
       ELSE lpad(CAST(o_orderkey % 12 + 1 AS {s}), 2, '0') || '/07/2026' END AS created_at,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS {s}) ELSE '2026-08-' || lpad(CAST(o_orderkey % 28 + 1 AS {s}), 2, '0') END AS completed_at,
  CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'Completed' END AS status,
  CASE WHEN o_orderkey % 71 = 0 THEN 'abc' WHEN o_orderkey % 73 = 0 THEN '(' || CAST(o_orderkey % 1000 + 1 AS {s}) || ')'
       WHEN o_orderkey % 79 = 0 THEN 'N/A' ELSE CAST(o_orderkey % 9 + 1 AS {s}) || ',000' END AS order_value
FROM orders
"""
SQL_DIRTY = DIRTY.format(s="VARCHAR")
#: The same in DuckDB with parsed columns.
SQL_PARSED = f"""
SELECT *, trim(coalesce(branch, '')) = '' AS b_branch, department IS NULL AS b_department,
  CASE WHEN created_at LIKE '%/%' THEN TRY_CAST(substr(created_at, 7, 4) || '-' || substr(created_at, 4, 2) || '-' || substr(created_at, 1, 2) AS DATE) ELSE TRY_CAST(created_at AS DATE) END AS v_created,
  TRY_CAST(completed_at AS DATE) AS v_completed,
  TRY_CAST(CASE WHEN order_value LIKE '(%)' THEN '-' || replace(replace(order_value, '(', ''), ')', '') ELSE replace(order_value, ',', '') END AS DOUBLE) AS v_value,
  lower(trim(priority)) AS k_priority
FROM ({SQL_DIRTY})
"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark_orders = table(spark, sf_dir, "orders")
    return spark.sql(DIRTY.format(s="STRING").replace("FROM orders", "FROM {orders}"), orders=spark_orders)


def _validator() -> Validator:
    return Validator(load_catalog(), Validation(issue_log_limit=0))


def _cleaner(**options) -> Cleaner:
    return Cleaner(load_catalog(), Cleaning(change_log_limit=0, **options))


def _counts(name: str):
    """checked and failed of the results of a check, by column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = _validator().validate(dirty(spark, sf_dir), "orders")
        rows = [(r.column or "(row)", r.checked, r.failed) for r in report.results if r.name == name]
        return spark.createDataFrame(rows, "column string, checked long, failed long")

    return run


query(
    "dq_missing_values",
    f"""WITH t AS ({SQL_PARSED}) SELECT 'request_id' AS "column", count(*) AS checked, CAST(0 AS BIGINT) AS failed FROM t
    UNION ALL SELECT 'branch', count(*), count(*) FILTER (b_branch) FROM t
    UNION ALL SELECT 'department', count(*), count(*) FILTER (b_department) FROM t
    UNION ALL SELECT 'priority', count(*), 0 FROM t UNION ALL SELECT 'created_at', count(*), 0 FROM t UNION ALL SELECT 'status', count(*), 0 FROM t
    UNION ALL SELECT 'completed_at', 0, 0""",
)(_counts("missing_values"))
query(
    "dq_invalid_dates",
    f"""WITH t AS ({SQL_PARSED}) SELECT 'created_at' AS "column", count(created_at) AS checked, count(*) FILTER (v_created IS NULL) AS failed FROM t
    UNION ALL SELECT 'completed_at', count(completed_at), count(*) FILTER (completed_at IS NOT NULL AND v_completed IS NULL) FROM t""",
)(_counts("invalid_dates"))
query(
    "dq_invalid_numbers",
    f"""WITH t AS ({SQL_PARSED}) SELECT 'order_value' AS "column", count(order_value) AS checked, count(*) FILTER (v_value IS NULL) AS failed FROM t""",
)(_counts("invalid_numbers"))
query(
    "dq_invalid_categories",
    f"""WITH t AS ({SQL_PARSED}) SELECT 'priority' AS "column", count(*) AS checked, count(*) FILTER (k_priority NOT IN ('critical', 'high', 'medium', 'low')) AS failed FROM t
    UNION ALL SELECT 'status', count(*), 0 FROM t""",
)(_counts("invalid_categories"))
query(
    "dq_negative_values",
    f"""WITH t AS ({SQL_PARSED}) SELECT 'order_value' AS "column", count(v_value) AS checked, count(*) FILTER (v_value < 0) AS failed FROM t""",
)(_counts("negative_values"))
query(
    "dq_consistency_rule",
    f"""WITH t AS ({SQL_PARSED}) SELECT 'completed_at' AS "column", count(*) FILTER (v_completed IS NOT NULL AND v_created IS NOT NULL) AS checked,
    count(*) FILTER (v_completed < v_created) AS failed FROM t""",
)(_counts("consistency_rule"))
query(
    "dq_duplicate_keys",
    f"""WITH t AS ({SQL_DIRTY}) SELECT '(row)' AS "column", CAST(0 AS BIGINT) AS checked, count(*) - count(DISTINCT lower(request_id)) AS failed FROM t""",
)(_counts("duplicate_keys"))

_RANGES = Catalog(
    {
        "customer": contract({"columns": {"c_custkey": {"type": "integer", "required": True}, "c_acctbal": {"type": "float", "min": 0}}}),
        "part": contract({"columns": {"p_size": {"type": "integer", "min": 5, "max": 45}, "p_retailprice": {"type": "float", "max": 1500}}}),
        "lineitem": contract({"columns": {"l_discount": {"type": "percent", "min": 0.01, "max": 0.09}, "l_quantity": {"type": "float", "min": 2}}}),
        "documents": contract({"business_key": ["text", "lang"], "columns": {"text": {"type": "string"}, "lang": {"type": "category", "required": True}}}),
    },
    weights({"completeness": 0.3, "validity": 0.25, "uniqueness": 0.2, "consistency": 0.15, "conformity": 0.1}),
)


@query(
    "dq_value_range",
    """SELECT 'negative_values' AS "check", 'c_acctbal' AS "column", count(c_acctbal) AS checked, count(*) FILTER (c_acctbal < 0) AS failed FROM customer
    UNION ALL SELECT 'below_minimum', 'p_size', count(p_size), count(*) FILTER (p_size < 5) FROM part
    UNION ALL SELECT 'above_maximum', 'p_size', count(p_size), count(*) FILTER (p_size > 45) FROM part
    UNION ALL SELECT 'above_maximum', 'p_retailprice', count(p_retailprice), count(*) FILTER (p_retailprice > 1500) FROM part
    UNION ALL SELECT 'invalid_percentages', 'l_discount', count(l_discount), count(*) FILTER (l_discount < 0.01 OR l_discount > 0.09) FROM lineitem
    UNION ALL SELECT 'below_minimum', 'l_quantity', count(l_quantity), count(*) FILTER (l_quantity < 2) FROM lineitem""",
)
def dq_value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("customer", "part", "lineitem"):
        report = Validator(_RANGES, Validation(duplicate_check=False)).validate(table(spark, sf_dir, name).select(*_RANGES[name].columns), name)
        rows += [(r.name, r.column, r.checked, r.failed) for r in report.results if r.dimension == "consistency"]
    return spark.createDataFrame(rows, "check string, column string, checked long, failed long")


@query(
    "dq_duplicate_rows",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(text), lang ORDER BY doc_id) AS n FROM documents) WHERE n > 1",
)
def dq_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW), "text", "lang")
    return repeats(docs, [values.strip(F.col("text")), F.col("lang")], "_again").where("_again").select(F.col(ROW).alias("doc_id"))


@query("dq_empty_rows", "SELECT count(*) FILTER (event_id % 10 = 0) AS empty_rows FROM events")
def dq_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hollow = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("a"), F.when(F.col("event_id") % 10 != 0, F.lit("x")).otherwise(" ").alias("b"))
    report = Validator(Catalog({"t": contract({"columns": {"a": {"type": "string"}}})}, _RANGES.weights)).validate(hollow, "t")
    return spark.createDataFrame([(sum(r.failed for r in report.results if r.name == "empty_rows"),)], "empty_rows long")


_SQL_OUTCOMES = f"""
WITH t AS ({SQL_PARSED}), n AS (SELECT count(*) AS n FROM t), d AS (
 SELECT 'completeness' AS dimension, 0.30 AS weight, 6 * count(*) AS checked, count(*) FILTER (b_branch) + count(*) FILTER (b_department) AS failed FROM t
 UNION ALL SELECT 'validity', 0.25, count(created_at) + count(completed_at) + count(order_value) + 2 * count(*),
   count(*) FILTER (v_created IS NULL) + count(*) FILTER (v_value IS NULL) + count(*) FILTER (k_priority = 'urgent') FROM t
 UNION ALL SELECT 'uniqueness', 0.20, count(*), count(*) - count(DISTINCT lower(request_id)) FROM t
 UNION ALL SELECT 'consistency', 0.15, count(v_value) + count(*) FILTER (v_completed IS NOT NULL AND v_created IS NOT NULL), count(*) FILTER (v_value < 0) + count(*) FILTER (v_completed < v_created) FROM t
 UNION ALL SELECT 'conformity', 0.10, 6, 0)
"""


@query("dq_dimension_scores", f"{_SQL_OUTCOMES} SELECT dimension, CAST(weight AS DOUBLE) AS weight, checked, failed, CAST(round((1 - failed / checked) * 100, 2) AS DOUBLE) AS score FROM d")
def dq_dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validator().validate(dirty(spark, sf_dir), "orders").dimensions_frame()


@query(
    "dq_quality_score",
    f"{_SQL_OUTCOMES} SELECT CAST(round(sum(CAST(weight AS DOUBLE) * round((1 - failed / checked) * 100, 2)) / sum(CAST(weight AS DOUBLE)), 1) AS DOUBLE) AS score FROM d",
)
def dq_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_validator().validate(dirty(spark, sf_dir), "orders").score,)], "score double")


_SQL_ISSUES = f"""
WITH t AS ({SQL_PARSED}), f AS (SELECT request_id, min(_source_row) AS f FROM t GROUP BY 1)
SELECT _source_row AS "row", 'branch' AS "column", 'missing_values' AS "check", branch AS value FROM t WHERE b_branch
UNION ALL SELECT _source_row, 'department', 'missing_values', department FROM t WHERE b_department
UNION ALL SELECT _source_row, 'created_at', 'invalid_dates', created_at FROM t WHERE v_created IS NULL
UNION ALL SELECT _source_row, 'order_value', 'invalid_numbers', order_value FROM t WHERE v_value IS NULL
UNION ALL SELECT _source_row, 'priority', 'invalid_categories', priority FROM t WHERE k_priority = 'urgent'
UNION ALL SELECT _source_row, 'order_value', 'negative_values', order_value FROM t WHERE v_value < 0
UNION ALL SELECT _source_row, 'completed_at', 'consistency_rule', completed_at FROM t WHERE v_completed < v_created
UNION ALL SELECT _source_row, '(row)', 'duplicate_keys', NULL FROM t JOIN f USING (request_id) WHERE f < _source_row
"""


@query("dq_issue_log", _SQL_ISSUES)
def dq_issue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validator().validate(dirty(spark, sf_dir), "orders").issues().select("row", "column", "check", "value")


#: The checks of the dirty orders in the order in which they are reported.
_CHECK_ORDER = """CASE WHEN "check" = 'missing_values' AND "column" = 'branch' THEN 1 WHEN "check" = 'missing_values' THEN 2 WHEN "check" = 'invalid_dates' THEN 3
  WHEN "check" = 'invalid_numbers' THEN 4 WHEN "check" = 'invalid_categories' THEN 5 WHEN "check" = 'negative_values' THEN 6 WHEN "check" = 'consistency_rule' THEN 7 ELSE 8 END"""


@query("dq_issue_log_capped", f'SELECT "row", "column", "check", value FROM ({_SQL_ISSUES}) ORDER BY {_CHECK_ORDER}, "row" LIMIT 400')
def dq_issue_log_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap keeps the checks that come first."""
    return Validator(load_catalog(), Validation(issue_log_limit=400)).validate(dirty(spark, sf_dir), "orders").issues().select("row", "column", "check", "value")


@query("dq_failed_checks", f"""SELECT "check", "column", 'error' AS severity, count(*) AS failed FROM ({_SQL_ISSUES}) GROUP BY 1, 2""")
def dq_failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _validator().validate(dirty(spark, sf_dir), "orders").failing
    return spark.createDataFrame([(r.name, r.column or "(row)", r.severity, r.failed) for r in found], "check string, column string, severity string, failed long")


@query(
    "dq_optional_severity",
    f"""SELECT 'completed_at' AS "column", CASE WHEN count(*) FILTER (completed_at IS NULL) * 100.0 / count(*) > 5 THEN 'warning' ELSE 'info' END AS at_5,
    CASE WHEN count(*) FILTER (completed_at IS NULL) * 100.0 / count(*) > 25 THEN 'warning' ELSE 'info' END AS at_25 FROM ({SQL_DIRTY})""",
)
def dq_optional_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optional column with blanks is a warning over the threshold only."""
    found = []
    for threshold in (5, 25):
        report = Validator(load_catalog(), Validation(missing_value_threshold=threshold)).validate(dirty(spark, sf_dir), "orders")
        found += [r.severity for r in report.results if r.name == "missing_values" and r.column == "completed_at"]
    return spark.createDataFrame([("completed_at", *found)], "column string, at_5 string, at_25 string")


@query(
    "dq_status",
    f"""SELECT 'orders' AS name, CASE WHEN (SELECT count(*) FROM ({_SQL_ISSUES})) > 0 THEN 'PASSED WITH WARNINGS' ELSE 'PASSED' END AS status, CAST(0 AS BIGINT) AS blocking, false AS raised
    UNION ALL SELECT 'nation', 'PASSED', 0, false
    UNION ALL SELECT 'discounts', CASE WHEN count(*) FILTER (l_discount > 0.02) * 100 > 50 * count(*) THEN 'FAILED' ELSE 'PASSED WITH WARNINGS' END, CAST(count(*) FILTER (l_discount > 0.02) * 100 > 50 * count(*) AS BIGINT), count(*) FILTER (l_discount > 0.02) * 100 > 50 * count(*) FROM lineitem
    UNION ALL SELECT 'nothing', 'FAILED', 1, true""",
)
def dq_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, blocking rules and the raise gate of four tables: faulty, clean, under the least score, and empty."""
    from tablewright.errors import ValidationFailed

    only = {d: 1.0 if d == "consistency" else 0.0 for d in _RANGES.weights}
    strict = Catalog({"n": contract({"columns": {"n_nationkey": {"type": "integer", "required": True}}}), "d": contract({"columns": {"l_discount": {"type": "percent", "max": 0.02}}})}, _RANGES.weights)
    scored = Catalog(strict.contracts, weights(only))
    nation, discounts = table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "lineitem").select("l_discount")
    off = Validation(duplicate_check=False)
    reports = {
        "orders": _validator().validate(dirty(spark, sf_dir), "orders"),
        "nation": Validator(strict, off).validate(nation, "n"),
        "discounts": Validator(scored, off).validate(discounts, "d"),
        "nothing": Validator(strict, off).validate(nation.limit(0), "n"),
    }
    rows = []
    for name, report in reports.items():
        try:
            report.raise_if_blocking()
            raised = False
        except ValidationFailed:
            raised = True
        rows.append((name, report.status, len(report.blocking), raised))
    return spark.createDataFrame(rows, "name string, status string, blocking long, raised boolean")


@query("dq_column_mapping", "SELECT 'column_mapping' AS name, 'info' AS severity, 'Ticket ID as request_id' AS part")
def dq_column_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir).withColumnRenamed("request_id", "Ticket ID")
    [found] = [r for r in _validator().validate(rows, "orders").results if r.name == "column_mapping"]
    return spark.createDataFrame([(found.name, found.severity, "Ticket ID as request_id" if "'Ticket ID' as request_id" in found.message else found.message)], "name string, severity string, part string")


@query("dq_custom_check", "SELECT 'whole_prices' AS name, 'p_retailprice' AS \"column\", count(*) AS checked, count(*) FILTER (p_retailprice % 1 <> 0) AS failed FROM part")
def dq_custom_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check from outside, beside the built-in ones."""
    from tablewright.operators.checks import CHECKS, Check, Finding

    class WholePrices(Check):
        name = "whole_prices"

        def findings(self, ctx) -> list[Finding]:
            value = ctx.value("p_retailprice")
            return [Finding(self.name, "validity", value.isNotNull(), value % 1 != 0, "p_retailprice", invalidates=True, message="{failed} price(s) are not whole.")]

    report = Validator(_RANGES, Validation(duplicate_check=False), (*CHECKS, WholePrices())).validate(table(spark, sf_dir, "part").select("p_size", "p_retailprice"), "part")
    return spark.createDataFrame([(r.name, r.column, r.checked, r.failed) for r in report.results if r.name == "whole_prices"], "name string, column string, checked long, failed long")


@query("dq_valid_invalid_split", f'SELECT CAST(o_orderkey AS BIGINT) AS _source_row, o_orderkey IN (SELECT "row" FROM ({_SQL_ISSUES})) AS invalid FROM orders')
def dq_valid_invalid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, _, _ = _validator().annotate(dirty(spark, sf_dir), "orders")
    return frame.select(ROW, F.col("_invalid").alias("invalid"))


@query(
    "dq_sample_rows",
    f'SELECT "check", "column", "row" FROM (SELECT *, row_number() OVER (PARTITION BY "check", "column" ORDER BY "row") AS n FROM ({_SQL_ISSUES})) WHERE n <= 20',
)
def dq_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _validator().validate(dirty(spark, sf_dir), "orders")
    by = {r.ordinal: r for r in report.results if r.failed}
    return spark.createDataFrame([(by[k].name, by[k].column or "(row)", x) for k, rows in report.samples().items() if k in by for x in rows], "check string, column string, row long")


# ------------------------------------------------------------------------- parsers
@query(
    "fn_parse_numeric",
    """SELECT l_orderkey, l_linenumber, l_partkey, n AS raw, TRY_CAST(CASE WHEN n LIKE '(%' THEN '-' || regexp_replace(n, '[()]', '', 'g') ELSE regexp_replace(n, '[,%₹ ]', '', 'g') END AS DOUBLE) AS value
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN CAST(l_partkey AS VARCHAR) || ',000.5' WHEN 1 THEN ' ' || CAST(l_partkey AS VARCHAR) || '%' WHEN 2 THEN '(' || CAST(l_partkey AS VARCHAR) || ')'
      WHEN 3 THEN '₹ ' || CAST(l_partkey AS VARCHAR) WHEN 4 THEN 'abc' ELSE '1e' || CAST(l_partkey % 5 AS VARCHAR) END AS n FROM lineitem)""",
)
def fn_parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey").cast("string")
    kinds = [F.concat(p, F.lit(",000.5")), F.concat(F.lit(" "), p, F.lit("%")), F.concat(F.lit("("), p, F.lit(")")), F.concat(F.lit("₹ "), p), F.lit("abc")]
    raw = F.concat(F.lit("1e"), (F.col("l_partkey") % 5).cast("string"))
    for k, text in enumerate(kinds):
        raw = F.when(F.col("l_partkey") % 6 == k, text).otherwise(raw)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return rows.withColumn("value", values.number(F.col("raw")).value)


@query(
    "fn_parse_dates",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d WHEN 3 THEN d ELSE NULL END AS value
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def fn_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    raw = F.lit("32/13/2026")
    for k, form in enumerate(("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd", "d MMM yyyy")):
        raw = F.when(F.col("o_orderkey") % 5 == k, F.date_format(d, form)).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", values.date(raw).value.alias("value"))


@query("fn_normalize_key", "SELECT c_custkey, lower(regexp_replace(trim('  ' || c_name || '   ' || c_mktsegment), ' +', ' ', 'g')) AS key FROM customer")
def fn_normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("  "), "c_name", F.lit(" \t "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", values.key(text).alias("key"))


@query("fn_standard_names", "SELECT * FROM (VALUES ('Invoice No.', 'invoice_no'), ('Discount %', 'discount_pct'), ('unitPrice', 'unit_price'), ('Bill #', 'bill_no'), ('***', 'column')) t(raw, name)")
def fn_standard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, names.standard(n)) for n in ("Invoice No.", "Discount %", "unitPrice", "Bill #", "***")], "raw string, name string")


@query("schema_resolution", "SELECT * FROM (VALUES ('request_id', 'Ticket ID'), ('branch', 'Branch'), ('order_value', 'orderValue')) t(contract, actual)")
def schema_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names.match(["Ticket ID", "Branch", "orderValue", "Remarks"], load_catalog()["orders"])
    return spark.createDataFrame(list(found.actual.items()), "contract string, actual string")


# ------------------------------------------------------------------------- cleaning
#: What cleaning makes of the dirty orders, in DuckDB.
SQL_CLEAN = f"""
SELECT p.*, CASE WHEN b_branch THEN NULL WHEN trim(branch) = '' THEN NULL ELSE 'North' END AS c_branch,
 CASE k_priority WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' WHEN 'medium' THEN 'medium' ELSE 'urgent' END AS c_priority,
 CASE WHEN order_value = 'N/A' THEN NULL ELSE order_value END AS r_value, lower(status) AS c_status,
 list_filter([CASE WHEN b_branch THEN 'missing branch' END, CASE WHEN b_department THEN 'missing department' END, CASE WHEN k_priority = 'urgent' THEN 'priority not in allowed list' END,
  CASE WHEN v_created IS NULL THEN 'invalid datetime in created_at' END, CASE WHEN v_value IS NULL AND order_value <> 'N/A' THEN 'invalid float in order_value' END,
  CASE WHEN v_value < 0 THEN 'order_value negative' END, CASE WHEN v_completed < v_created THEN 'completed_at before created_at' END], lambda x: x IS NOT NULL) AS reasons0
FROM ({SQL_PARSED}) p
"""
SQL_REASONS = f"""
WITH c AS ({SQL_CLEAN}), f AS (SELECT request_id, min(_source_row) AS f FROM c WHERE len(reasons0) = 0 GROUP BY 1)
SELECT c.*, CASE WHEN len(reasons0) = 0 AND f.f < c._source_row THEN ['duplicate business key (request_id)'] ELSE reasons0 END AS reasons
FROM c LEFT JOIN f USING (request_id)
"""


@query(
    "clean_orders",
    f"""SELECT _source_row, request_id, c_branch AS branch, department, c_priority AS priority, CAST(v_created AS TIMESTAMP) AS created_at, CAST(v_completed AS TIMESTAMP) AS completed_at,
    c_status AS status, v_value AS order_value FROM ({SQL_REASONS}) WHERE len(reasons) = 0""",
)
def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaner().clean(dirty(spark, sf_dir), "orders").data


@query("clean_quarantine", f"SELECT _source_row, branch, order_value, array_to_string(reasons, '; ') AS _reason FROM ({SQL_REASONS}) WHERE len(reasons) > 0")
def clean_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaner().clean(dirty(spark, sf_dir), "orders").quarantine.select(ROW, "branch", "order_value", "_reason")


@query("clean_reason_histogram", f"SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM ({SQL_REASONS})) GROUP BY 1")
def clean_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reason_histogram(_cleaner().clean(dirty(spark, sf_dir), "orders").quarantine)


@query(
    "clean_change_log",
    f"""WITH c AS ({SQL_CLEAN})
    SELECT _source_row AS source_row, 'branch' AS "column", 'Trim whitespace' AS step, branch AS old_value, trim(branch) AS new_value FROM c WHERE branch <> trim(branch)
    UNION ALL SELECT _source_row, 'priority', 'Trim whitespace', priority, trim(priority) FROM c WHERE priority <> trim(priority)
    UNION ALL SELECT _source_row, 'branch', 'Placeholders → missing', '', NULL FROM c WHERE b_branch
    UNION ALL SELECT _source_row, 'order_value', 'Placeholders → missing', order_value, NULL FROM c WHERE order_value = 'N/A'
    UNION ALL SELECT _source_row, 'branch', 'Standardise categories', trim(branch), c_branch FROM c WHERE NOT b_branch AND trim(branch) <> c_branch
    UNION ALL SELECT _source_row, 'priority', 'Standardise categories', trim(priority), c_priority FROM c WHERE trim(priority) <> c_priority
    UNION ALL SELECT _source_row, 'status', 'Standardise categories', status, c_status FROM c WHERE status <> c_status
    UNION ALL SELECT _source_row, 'created_at', 'Convert data types', created_at, NULL FROM c WHERE v_created IS NULL
    UNION ALL SELECT _source_row, 'order_value', 'Convert data types', order_value, NULL FROM c WHERE v_value IS NULL AND order_value <> 'N/A'""",
)
def clean_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaner().clean(dirty(spark, sf_dir), "orders").changes()


#: The changes of the dirty orders: step, place of the column, row, column, whether the row stays.
_SQL_CHANGES = f"""
 WITH c AS ({SQL_REASONS})
 SELECT 0 AS step, 1 AS ordinal, _source_row, 'branch' AS "column", len(reasons) = 0 AS kept FROM c WHERE branch <> trim(branch)
 UNION ALL SELECT 0, 3, _source_row, 'priority', len(reasons) = 0 FROM c WHERE priority <> trim(priority)
 UNION ALL SELECT 1, 1, _source_row, 'branch', len(reasons) = 0 FROM c WHERE b_branch
 UNION ALL SELECT 1, 7, _source_row, 'order_value', len(reasons) = 0 FROM c WHERE order_value = 'N/A'
 UNION ALL SELECT 2, 1, _source_row, 'branch', len(reasons) = 0 FROM c WHERE NOT b_branch AND trim(branch) <> c_branch
 UNION ALL SELECT 2, 3, _source_row, 'priority', len(reasons) = 0 FROM c WHERE trim(priority) <> c_priority
 UNION ALL SELECT 2, 6, _source_row, 'status', len(reasons) = 0 FROM c WHERE status <> c_status
 UNION ALL SELECT 3, 4, _source_row, 'created_at', len(reasons) = 0 FROM c WHERE v_created IS NULL
 UNION ALL SELECT 3, 7, _source_row, 'order_value', len(reasons) = 0 FROM c WHERE v_value IS NULL AND order_value <> 'N/A'
"""


@query("clean_change_log_capped", f"""SELECT _source_row AS source_row, "column", list_extract(['Trim whitespace', 'Placeholders → missing', 'Standardise categories', 'Convert data types'], number + 1) AS step
    FROM (SELECT *, step AS number FROM ({_SQL_CHANGES})) ORDER BY number, ordinal, _source_row LIMIT 7000""")
def clean_change_log_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap keeps the changes of the first steps and columns."""
    out = Cleaner(load_catalog(), Cleaning(change_log_limit=7000)).clean(dirty(spark, sf_dir), "orders")
    return out.changes().select("source_row", "column", "step")


@query("clean_rows_modified", f"SELECT count(DISTINCT _source_row) FILTER (kept) AS rows_modified, count(*) AS cells FROM ({_SQL_CHANGES})")
def clean_rows_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cleaner().clean(dirty(spark, sf_dir), "orders")
    return spark.createDataFrame([(out.modified, out.cells)], "rows_modified long, cells long")


@query(
    "clean_summary",
    f"SELECT count(*) AS rows_before, count(*) FILTER (len(reasons) = 0) AS rows_after, count(*) FILTER (len(reasons) > 0) AS rows_removed FROM ({SQL_REASONS})",
)
def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cleaner().clean(dirty(spark, sf_dir), "orders")
    return spark.createDataFrame([(out.before, out.after, out.removed)], "rows_before long, rows_after long, rows_removed long")


@query(
    "clean_keep_flagged",
    f"SELECT _source_row, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ') END AS _dq_issues FROM ({SQL_REASONS})",
)
def clean_keep_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaner(invalid_rows="keep").clean(dirty(spark, sf_dir), "orders").data.select(ROW, "_dq_issues")


@query(
    "clean_modal_spelling",
    """SELECT k AS key, s AS spelling FROM (SELECT lower(s) AS k, s, row_number() OVER (PARTITION BY lower(s) ORDER BY count(*) DESC, CASE WHEN s = upper(s) OR s = lower(s) THEN 1 ELSE 0 END, s) AS n
    FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS s FROM customer) GROUP BY s) WHERE n = 1""",
)
def clean_modal_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, k = F.col("c_mktsegment"), F.col("c_custkey") % 3
    text = F.when(k == 0, F.lower(seg)).when(k == 1, seg).otherwise(F.concat(F.upper(F.substring(seg, 1, 1)), F.lower(F.substring(seg, 2, 100))))
    return modal_spellings(table(spark, sf_dir, "customer").select(text.alias("s")), ["s"]).select(F.col("_k").alias("key"), F.col("_v").alias("spelling"))


@query("clean_integer_decision", "SELECT 'bigint' AS size_type, CASE WHEN count(*) FILTER (p_retailprice % 1 <> 0) = 0 THEN 'bigint' ELSE 'double' END AS price_type FROM part")
def clean_integer_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Catalog({"p": contract({"columns": {"size": {"type": "integer"}, "price": {"type": "integer"}}})}, _RANGES.weights)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(ROW), F.col("p_size").cast("string").alias("size"), F.col("p_retailprice").cast("string").alias("price"))
    types = dict(Cleaner(own, Cleaning(remove_duplicate_rows=False)).clean(rows, "p").data.dtypes)
    return spark.createDataFrame([(types["size"], types["price"])], "size_type string, price_type string")


# ------------------------------------------------------------------------ profiling
@query(
    "profile_columns",
    """SELECT 'event_type' AS name, 'category' AS detected_type, count(event_type) AS non_null_count, count(DISTINCT event_type) AS unique_count FROM events
    UNION ALL SELECT 'user_id', 'integer', count(user_id), count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'value', 'float', count(value), count(DISTINCT value) FROM events
    UNION ALL SELECT 'ts', 'datetime', count(ts), count(DISTINCT ts) FROM events""",
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.profile(table(spark, sf_dir, "events").select("event_type", "user_id", "value", "ts"), with_samples=False)
    return spark.createDataFrame([(p.name, p.detected_type, p.non_null_count, p.unique_count) for p in rows], "name string, detected_type string, non_null_count long, unique_count long")


@query(
    "profile_type_votes",
    "SELECT * FROM (VALUES ('day', 'date'), ('pct', 'percent'), ('flag', 'boolean'), ('n', 'integer'), ('x', 'float'), ('c', 'category'), ('t', 'string'), ('e', 'empty')) v(name, detected_type)",
)
def profile_type_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    columns = {
        "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "pct": F.concat((key % 100).cast("string"), F.lit("%")), "flag": F.when(key % 2 == 0, "Yes").otherwise("no"),
        "n": F.concat(text, F.lit(",000")), "x": F.concat(text, F.lit(".5")), "c": F.col("o_orderpriority"), "t": F.concat(F.lit("order number "), text), "e": F.lit(" "),
    }
    rows = profile.profile(table(spark, sf_dir, "orders").select(*[c.alias(n) for n, c in columns.items()]), with_samples=False)
    return spark.createDataFrame([(p.name, p.detected_type) for p in rows], "name string, detected_type string")


@query("profile_samples", "SELECT doc_id AS at, lang FROM (SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang ORDER BY 1 LIMIT 3)")
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW), "lang")
    found = profile.samples(docs, "lang")
    return docs.where(F.col("lang").isin(list(found))).groupBy("lang").agg(F.min(ROW).alias("at"))


# ----------------------------------------------------------- relations of sample data
@query("gen_merge_lines", "SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS quantity, max(l_linenumber) AS last_line FROM lineitem GROUP BY 1, 2")
def gen_merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.max("l_linenumber").alias("last_line"))


@query(
    "gen_rolling_28d",
    """SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS n_28d
    FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)""",
)
def gen_rolling_28d(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return daily.selectExpr("*", "sum(n) OVER (PARTITION BY event_type ORDER BY unix_date(day) RANGE BETWEEN 27 PRECEDING AND CURRENT ROW) AS n_28d")


@query(
    "gen_positional_insert",
    """SELECT row_number() OVER (ORDER BY place, old, n_name) AS _source_row, n_name FROM (SELECT n_nationkey + 1 AS place, 1 AS old, n_name FROM nation
    UNION ALL SELECT n_nationkey % 7 * 4 + 1, 0, 'copy of ' || n_name FROM nation WHERE n_regionkey = 1)""",
)
def gen_positional_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    rows = nation.select((F.col("n_nationkey").cast("long") + 1).alias(ROW), "n_name")
    copies = nation.where("n_regionkey = 1").select((F.col("n_nationkey").cast("long") % 7 * 4 + 1).alias("place"), F.concat(F.lit("copy of "), "n_name").alias("n_name"))
    return samples.insert(rows, copies, "place")


@query("gen_sorted_rows", "SELECT row_number() OVER (ORDER BY p_brand, p_size, p_partkey) AS _source_row, p_partkey FROM part")
def gen_sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.in_order(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size", "p_partkey"]).select(ROW, "p_partkey")


@query("gen_last_sale", "SELECT l_partkey, max(l_shipdate) AS last_sale FROM lineitem GROUP BY 1")
def gen_last_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").alias("last_sale"))


@query(
    "gen_grid_left_join",
    """SELECT n_nationkey, seg AS c_mktsegment, coalesce(n, 0) AS customers FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer)
    LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) ON c_nationkey = n_nationkey AND c_mktsegment = seg""",
)
def gen_grid_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    segments = customer.select("c_mktsegment").distinct()  # a handful
    counts = customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    grid = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(segments)
    return grid.join(counts, ["n_nationkey", "c_mktsegment"], "left").select("n_nationkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("customers"))


@query("gen_invoice_sequence", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders")
def gen_invoice_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("seq"))


@query("gen_lookup_join", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def gen_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")


@query("gen_latest_snapshot", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def gen_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("snapshot_date"))
    return measures.latest(orders).where("_latest").select("o_orderkey")


# ------------------------------------------------------------------------- measures
_SALES = """SELECT l_orderkey AS invoice_no, CAST(l_shipdate AS DATE) AS invoice_date, l_returnflag AS branch, l_linestatus AS category, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(p_size AS DOUBLE) AS unit_price, CAST(CAST(round(l_discount * 100) AS INT) AS DOUBLE) AS discount_pct, CAST(p_size AS DOUBLE) / 2 AS cost_price FROM lineitem JOIN part ON p_partkey = l_partkey"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SALES.replace("FROM lineitem", "FROM {lineitem}").replace("JOIN part", "JOIN {part}"), lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "kpi_sales",
    f"""SELECT branch, sum(quantity * unit_price) AS total_sales, round(sum(quantity * unit_price * (1 - discount_pct / 100)), 4) AS net_sales, count(DISTINCT invoice_no) AS order_count, CAST(sum(quantity) AS BIGINT) AS units_sold,
    round(sum(quantity * unit_price * (1 - discount_pct / 100)) / count(DISTINCT invoice_no), 4) AS avg_order_value, round(sum(quantity * unit_price * (1 - discount_pct / 100)) / sum(quantity), 4) AS avg_selling_price
    FROM ({_SALES}) GROUP BY 1""",
)
def kpi_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.calculate(sales(spark, sf_dir), ["total_sales", "net_sales", "order_count", "units_sold", "avg_order_value", "avg_selling_price"], ["branch"]))


@query(
    "kpi_margin",
    f"""SELECT branch, category, grouping(branch, category) > 0 AS _all, sum(quantity * cost_price) AS total_cost, round(sum(quantity * unit_price * (1 - discount_pct / 100)) - sum(quantity * cost_price), 4) AS gross_profit,
    round((sum(quantity * unit_price * (1 - discount_pct / 100)) - sum(quantity * cost_price)) / sum(quantity * unit_price * (1 - discount_pct / 100)) * 100, 4) AS gross_margin_pct,
    round(avg((quantity * unit_price * (1 - discount_pct / 100) - quantity * cost_price) / (quantity * unit_price * (1 - discount_pct / 100)) * 100), 4) AS avg_margin_pct
    FROM ({_SALES}) GROUP BY GROUPING SETS ((branch, category), ())""",
)
def kpi_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.calculate(sales(spark, sf_dir), ["total_cost", "gross_profit", "gross_margin_pct", "avg_margin_pct"], ["branch", "category"], total=True))


@query(
    "kpi_growth",
    f"""SELECT "current", previous, round(("current" - previous) / previous * 100, 4) AS growth_pct FROM (SELECT CAST(sum(quantity) FILTER (invoice_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') AS BIGINT) AS "current",
    CAST(sum(quantity) FILTER (invoice_date BETWEEN DATE '1994-12-31' AND DATE '1995-12-31') AS BIGINT) AS previous FROM ({_SALES}))""",
)
def kpi_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.growth(sales(spark, sf_dir), "invoice_date", F.col("quantity"), "1996-01-01", "1996-12-31"))


_STOCK = """SELECT CAST(o_orderdate AS DATE) AS snapshot_date, o_orderkey % 40 AS stock_qty, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS unit_cost, CAST(o_orderkey % 5 AS DOUBLE) AS avg_daily_sales,
  {minus} AS last_sale_date, o_orderpriority AS branch FROM orders"""
_SQL_STOCK = _STOCK.format(minus="CAST(o_orderdate AS DATE) - CAST(o_orderkey % 90 AS INT)")


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_STOCK.format(minus="date_sub(CAST(o_orderdate AS DATE), CAST(o_orderkey % 90 AS INT))").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


@query(
    "kpi_inventory",
    f"""SELECT CAST(sum(stock_qty) AS BIGINT) AS stock_quantity, sum(stock_qty * unit_cost) AS stock_value, round(sum(stock_qty) / sum(avg_daily_sales), 4) AS stock_days,
    round(count(*) FILTER (stock_qty <= 0) / count(*) * 100, 4) AS out_of_stock_pct, count(*) FILTER (snapshot_date - last_sale_date > 60) AS slow_moving_items,
    round(sum(avg_daily_sales * unit_cost) * 365 / sum(stock_qty * unit_cost), 4) AS inventory_turnover FROM ({_SQL_STOCK}) WHERE snapshot_date = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)""",
)
def kpi_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.calculate(stock(spark, sf_dir), ["stock_quantity", "stock_value", "stock_days", "out_of_stock_pct", "slow_moving_items", "inventory_turnover"]))


@query(
    "kpi_top_n",
    f"SELECT branch, category, sum(quantity * unit_price) AS total_sales FROM ({_SALES}) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 3",
)
def kpi_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.top(measures.calculate(sales(spark, sf_dir), ["total_sales"], ["branch", "category"]), "total_sales", 3)


@query("kpi_enrich", f"SELECT invoice_no, CAST(date_trunc('month', invoice_date) AS DATE) AS month, CAST(sum(quantity * cost_price) AS DOUBLE) AS cost FROM ({_SALES}) GROUP BY 1, 2")
def kpi_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.enrich(sales(spark, sf_dir)).groupBy("invoice_no", "month").agg(F.sum("cost").alias("cost"))


# ------------------------------------------------------------------------ work time
_REQUESTS = """SELECT event_id AS request_id, ts AS created_at, {plus} AS completed_at,
  CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority,
  CASE event_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'cancelled' ELSE 'completed' END AS status FROM events"""
_SQL_REQUESTS = _REQUESTS.format(plus="ts + to_hours(CAST(event_id % 50 AS INT))")
_SQL_TAT = f"""
WITH r AS ({_SQL_REQUESTS}), days AS (
  SELECT day, CASE WHEN isodow(day) = 7 OR day IN (DATE '2024-01-26', DATE '2024-08-15') THEN 0 ELSE 1 END AS works FROM (SELECT CAST(unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events), (SELECT CAST(max(ts) + INTERVAL 50 HOURS AS DATE) FROM events), INTERVAL 1 DAY)) AS DATE) AS day)),
c AS (SELECT day, works, coalesce(sum(works) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM days),
t AS (SELECT r.*, CAST((e.before * 32400 + e.works * least(greatest(CAST(hour(completed_at) * 3600 + minute(completed_at) * 60 + CAST(floor(second(completed_at)) AS INT) AS INT) - 28800, 0), 32400))
  - (s.before * 32400 + s.works * least(greatest(hour(created_at) * 3600 + minute(created_at) * 60 + CAST(floor(second(created_at)) AS INT) - 28800, 0), 32400)) AS DOUBLE) / 3600.0 AS tat_hours
  FROM r JOIN c s ON s.day = CAST(created_at AS DATE) JOIN c e ON e.day = CAST(completed_at AS DATE))
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _REQUESTS.format(plus="timestampadd(HOUR, CAST(event_id % 50 AS INT), ts)").replace("FROM events", "FROM {events}")
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


def _with_tat(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = spark.sql("select explode(array(date'2024-01-26', date'2024-08-15')) as holiday_date")
    return worktime.with_sla(worktime.turnaround(requests(spark, sf_dir), "created_at", "completed_at", Calendar(), off))


@query("tat_working_hours", f"{_SQL_TAT} SELECT request_id, round(tat_hours, 4) AS tat_hours FROM t")
def tat_working_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_with_tat(spark, sf_dir).select("request_id", "tat_hours"))


@query(
    "kpi_operations",
    f"""{_SQL_TAT} SELECT count(*) FILTER (status <> 'cancelled') AS total_requests, count(*) FILTER (status = 'completed') AS completed_requests, count(*) FILTER (status IN ('open', 'in_progress')) AS pending_requests,
    round(count(*) FILTER (status = 'completed') / count(*) FILTER (status <> 'cancelled') * 100, 4) AS completion_pct, round(avg(tat_hours), 4) AS avg_tat_hours,
    round(count(*) FILTER (tat_hours <= CASE priority WHEN 'critical' THEN 2 WHEN 'high' THEN 4 WHEN 'medium' THEN 8 ELSE 24 END) / count(*) * 100, 4) AS sla_compliance_pct FROM t""",
)
def kpi_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ["total_requests", "completed_requests", "pending_requests", "completion_pct", "avg_tat_hours", "sla_compliance_pct"]
    return _rounded(measures.calculate(_with_tat(spark, sf_dir), codes))


@query(
    "sla_compliance",
    f"{_SQL_TAT} SELECT priority, count(*) AS n, count(*) FILTER (tat_hours <= CASE priority WHEN 'critical' THEN 2 WHEN 'high' THEN 4 WHEN 'medium' THEN 8 ELSE 24 END) AS in_time FROM t GROUP BY 1",
)
def sla_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_tat(spark, sf_dir).groupBy("priority").agg(F.count("*").alias("n"), F.count_if("in_time").alias("in_time"))


# ------------------------------------------------------------------------- outliers
_DAILY = "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DAILY.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@query(
    "anomaly_iqr",
    f"""WITH d AS ({_DAILY}), q AS (SELECT event_type, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3, count(*) AS c FROM d GROUP BY 1)
    SELECT event_type, day, n, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high, c >= 5 AND (n < q1 - 1.5 * (q3 - q1) OR n > q3 + 1.5 * (q3 - q1)) AS is_anomaly FROM d JOIN q USING (event_type)""",
)
def anomaly_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.detect(daily(spark, sf_dir), "n", "day", ["event_type"])


@query(
    "anomaly_zscore",
    f"""WITH d AS ({_DAILY}), q AS (SELECT event_type, avg(n) AS m, stddev_samp(n) AS s, count(*) AS c FROM d GROUP BY 1)
    SELECT event_type, day, n, round((n - m) / nullif(s, 0), 4) AS zscore, coalesce(c >= 5 AND abs((n - m) / nullif(s, 0)) > 2, false) AS is_anomaly FROM d JOIN q USING (event_type)""",
)
def anomaly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(outliers.detect(daily(spark, sf_dir), "n", "day", ["event_type"], Anomaly(method="zscore", zscore_threshold=2)))


@query(
    "anomaly_rolling",
    f"""SELECT event_type, day, n, round(e, 4) AS expected, round((n - e) / abs(nullif(e, 0)) * 100, 4) AS deviation_pct, coalesce(c >= 5 AND abs((n - e) / nullif(e, 0) * 100) > 50, false) AS is_anomaly
    FROM (SELECT *, avg(n) OVER w AS e, count(n) OVER w AS c FROM ({_DAILY}) WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))""",
)
def anomaly_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(outliers.detect(daily(spark, sf_dir), "n", "day", ["event_type"], Anomaly(method="rolling")))


@query(
    "anomaly_pct_change",
    f"""SELECT event_type, day, n, round((n - p) / abs(nullif(p, 0)) * 100, 4) AS change_pct, coalesce(abs((n - p) / nullif(p, 0) * 100) > 100, false) AS is_anomaly
    FROM (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS p FROM ({_DAILY}))""",
)
def anomaly_pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(outliers.detect(daily(spark, sf_dir), "n", "day", ["event_type"], Anomaly(method="pct_change")))


# ----------------------------------------------------------------------- exceptions
@query(
    "rule_flags_sales",
    f"""SELECT exception, count(*) AS n FROM (SELECT unnest([CASE WHEN discount_pct > 5 THEN 'high_discount' END, CASE WHEN unit_price = 0 THEN 'zero_price' END, CASE WHEN quantity * unit_price < 0 THEN 'negative_sales' END,
    CASE WHEN (1 - discount_pct / 100) * 2 - 1 >= 0 AND (((1 - discount_pct / 100) * 2 - 1) / ((1 - discount_pct / 100) * 2) * 100) < 46 THEN 'low_margin' END]) AS exception FROM ({_SALES})) WHERE exception IS NOT NULL GROUP BY 1""",
)
def rule_flags_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.plans.settings import Thresholds

    return exceptions.histogram(exceptions.sales(sales(spark, sf_dir), Thresholds(max_discount_percent=5, minimum_margin_percent=46)))


@query(
    "rule_flags_inventory",
    f"""SELECT exception, count(*) AS n FROM (SELECT unnest([CASE WHEN stock_qty <= 0 THEN 'stockout' END, CASE WHEN stock_qty > 0 AND stock_qty / nullif(avg_daily_sales, 0) < 7 THEN 'low_stock' END,
    CASE WHEN stock_qty / nullif(avg_daily_sales, 0) > 120 THEN 'overstock' END, CASE WHEN snapshot_date - last_sale_date > 60 THEN 'slow_moving' END]) AS exception FROM ({_SQL_STOCK})) WHERE exception IS NOT NULL GROUP BY 1""",
)
def rule_flags_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exceptions.histogram(exceptions.inventory(stock(spark, sf_dir)))


@query("rule_flags_orders", "SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'high_value' ELSE '' END AS codes FROM orders")
def rule_flags_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exceptions.orders(table(spark, sf_dir, "orders").withColumn("order_value", F.col("o_totalprice")))
    return rows.select("o_orderkey", F.array_join("exceptions", ",").alias("codes"))


# -------------------------------------------------------------------------- sources
def _nation_cells(spark: SparkSession, sf_dir: str) -> list[list[str]]:
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    return [["Nation Key", "Name", "Region Key"], *[[str(r["n_nationkey"]), r["n_name"], str(r["n_regionkey"])] for r in rows]]


_SQL_NATION = """SELECT row_number() OVER (ORDER BY n_nationkey) AS _source_row, CAST(n_nationkey AS VARCHAR) AS nation_key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region_key FROM nation"""


def _named(df: DataFrame) -> DataFrame:
    return df.toDF(*[c if c == ROW else names.standard(c) for c in df.columns])


@query("src_csv_scan", _SQL_NATION)
def src_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semicolons, a title above the header, another encoding."""
    from tablewright.sources.load import for_upload

    text = "List of nations;;\n" + "\n".join(";".join(r) for r in _nation_cells(spark, sf_dir)) + "\n"
    return _named(for_upload(spark, "nation.csv", text.encode("utf-16")).table()[0])


@query("src_workbook_scan", _SQL_NATION)
def src_workbook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import os
    import tempfile

    from tablewright.sources import workbook
    from tablewright.sources.load import for_upload

    header, *rows = _nation_cells(spark, sf_dir)
    handle, path = tempfile.mkstemp(suffix=".xlsx")
    os.close(handle)
    workbook.write(path, {"Nations": (header, rows)})
    with open(path, "rb") as f:
        content = f.read()
    os.unlink(path)
    return _named(for_upload(spark, "nation.xlsx", content).table()[0])


@query("src_sheets_scan", _SQL_NATION)
def src_sheets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.sources.load import Sheets

    cells = _nation_cells(spark, sf_dir)

    class Client:
        def worksheets(self) -> list[str]:
            return ["Nations"]

        def values(self, title: str) -> list[list[str]]:
            return cells

    return _named(Sheets(spark, Client()).table()[0])


@query("src_sql_scan", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey < 3 GROUP BY 1")
def src_sql_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.sources.load import Sql

    table(spark, sf_dir, "nation").createOrReplaceTempView("tablewright_nation")
    source = Sql(spark, query="select n_regionkey, count(*) as n from tablewright_nation where n_regionkey < :below group by 1", params={"below": 3})
    return source.table()[0].drop(ROW)


@query("src_row_numbers", "SELECT count(*) AS n, CAST(min(event_id) - min(event_id) + 1 AS BIGINT) AS first, count(*) AS last, count(*) AS different FROM events")
def src_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.operators.rows import numbered

    rows = numbered(table(spark, sf_dir, "events").repartition(5))
    return rows.agg(F.count("*").alias("n"), F.min(ROW).alias("first"), F.max(ROW).alias("last"), F.count_distinct(ROW).alias("different"))


@query("src_preview", "SELECT row_number() OVER (ORDER BY n_nationkey) AS _source_row, n_nationkey, n_name FROM nation ORDER BY 1 LIMIT 7")
def src_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.sources.load import Parquet

    return Parquet(spark, f"{sf_dir}/nation.parquet").load().preview(7).select(ROW, "n_nationkey", "n_name")


@query(
    "src_profile_table",
    """SELECT 'p_partkey' AS name, 'integer' AS detected_type, count(*) AS non_null_count, CAST(0 AS BIGINT) AS null_count, count(DISTINCT p_partkey) AS unique_count FROM part
    UNION ALL SELECT 'p_brand', 'category', count(*), 0, count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_size', 'integer', count(*), 0, count(DISTINCT p_size) FROM part""",
)
def src_profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.sources.load import Parquet

    rows = Parquet(spark, f"{sf_dir}/part.parquet").load().columns_frame()
    return rows.where(F.col("name").isin("p_partkey", "p_brand", "p_size")).select("name", "detected_type", "non_null_count", "null_count", "unique_count")


@query("src_path_scan", "SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def src_path_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as delimited files of a folder, of which the driver reads the first lines alone."""
    import atexit
    import shutil
    import tempfile
    import uuid

    from tablewright.sources import sinks
    from tablewright.sources.load import create

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:  # only where no shared folder is named, as in tests
        shared = tempfile.mkdtemp(prefix="tablewright-")
        atexit.register(shutil.rmtree, shared, True)
    folder = f"{shared.rstrip('/')}/orders-{uuid.uuid4().hex}"
    sinks.to_csv(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Order Key"), F.col("o_orderpriority").alias("Priority"), F.col("o_custkey").alias("Customer")), folder, header=False)
    rows = create("delimited_path", spark, folder, header=None).table()[0]
    return rows.select(F.col("column_1").alias("order_key"), F.col("column_2").alias("priority"), F.col("column_3").alias("customer"))


@query("src_registry", "SELECT * FROM (VALUES ('avro', '.avro'), ('csv', '.csv,.tsv,.txt'), ('delimited_path', ''), ('json', '.json,.jsonl'), ('orc', '.orc'), ('parquet', '.parquet'), ('sheets', ''), ('sql', ''), ('xlsx', '.xlsx')) t(kind, endings)")
def src_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.sources.load import kinds

    return spark.createDataFrame([(k, ",".join(sorted(e))) for k, e in kinds().items()], "kind string, endings string")


# -------------------------------------------------------------- reports and summaries
@query("dq_metrics", f"""WITH t AS ({SQL_PARSED}) SELECT
 CAST(round((count(*) FILTER (b_branch) + count(*) FILTER (b_department)) / (6 * count(*)) * 100, 2) AS DOUBLE) AS missing_values_pct,
 CAST(round((count(*) - count(DISTINCT request_id)) / count(*) * 100, 2) AS DOUBLE) AS duplicate_pct,
 CAST(round(count(*) FILTER (v_created IS NULL) / (count(created_at) + count(completed_at)) * 100, 2) AS DOUBLE) AS invalid_dates_pct,
 CAST(round(count(*) FILTER (v_value IS NULL) / count(order_value) * 100, 2) AS DOUBLE) AS invalid_numbers_pct,
 CAST(round(count(*) FILTER (k_priority = 'urgent') / (2 * count(*)) * 100, 2) AS DOUBLE) AS invalid_categories_pct FROM t""")
def dq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _validator().validate(dirty(spark, sf_dir), "orders").metrics
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))


@query("dq_checks_table", f"""WITH i AS ({_SQL_ISSUES}) SELECT "check", nullif("column", '(row)') AS "column", count(*) AS failed FROM i GROUP BY 1, 2""")
def dq_checks_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validator().validate(dirty(spark, sf_dir), "orders").checks_frame().where("failed > 0").select("check", "column", "failed")


@query("dq_required_columns", "SELECT 'required_columns' AS name, 'error' AS severity, 7 AS checked, 2 AS failed, true AS blocking")
def dq_required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("Branch"), F.lit("1").alias("SKU"), F.lit("c").alias("category"), F.lit("2").alias("qty"), F.lit("x").alias("invoice_no"))
    [found] = [r for r in _validator().validate(rows, "sales").results if r.name == "required_columns"]
    return spark.createDataFrame([(found.name, found.severity, found.checked, found.failed, found.blocking)], "name string, severity string, checked int, failed int, blocking boolean")


@query("dq_unexpected_columns", "SELECT 'unexpected_columns' AS name, 'error' AS severity, 4 AS checked, 2 AS failed")
def dq_unexpected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = Catalog({"p": contract({"allow_unexpected_columns": False, "columns": {"p_partkey": {"type": "integer"}, "p_size": {"type": "integer"}}})}, _RANGES.weights)
    report = Validator(strict).validate(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type"), "p")
    [found] = [r for r in report.results if r.name == "unexpected_columns"]
    return spark.createDataFrame([(found.name, found.severity, found.checked, found.failed)], "name string, severity string, checked int, failed int")


@query("dq_detect_dataset", "SELECT * FROM (VALUES ('orders', 'orders'), ('nation', NULL)) t(source, detected)")
def dq_detect_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load_catalog().contracts
    return spark.createDataFrame([("orders", names.guess(dirty(spark, sf_dir).columns, known)), ("nation", names.guess(table(spark, sf_dir, "nation").columns, known))], "source string, detected string")


@query(
    "clean_column_changes",
    f"""WITH c AS ({SQL_REASONS}) SELECT 'branch' AS "column", 'string' AS type_before, 'string' AS type_after, count(*) FILTER (b_branch) AS missing_before, CAST(0 AS BIGINT) AS missing_after FROM c
    UNION ALL SELECT 'order_value', 'string', 'double', count(*) FILTER (order_value IS NULL), count(*) FILTER (len(reasons) = 0 AND v_value IS NULL) FROM c""",
)
def clean_column_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cleaner().clean(dirty(spark, sf_dir), "orders").column_changes()
    return out.where(F.col("column").isin("branch", "order_value")).select("column", "type_before", "type_after", "missing_before", "missing_after")


@query(
    "clean_steps",
    f"""WITH c AS ({SQL_CLEAN}) SELECT 'Trim whitespace' AS step, count(*) FILTER (branch <> trim(branch)) + count(*) FILTER (priority <> trim(priority)) AS cells FROM c
    UNION ALL SELECT 'Placeholders → missing', count(*) FILTER (b_branch) + count(*) FILTER (order_value = 'N/A') FROM c
    UNION ALL SELECT 'Convert data types', count(*) FILTER (v_created IS NULL) + count(*) FILTER (v_value IS NULL AND order_value <> 'N/A') FROM c""",
)
def clean_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["Trim whitespace", "Placeholders → missing", "Convert data types"]
    return _cleaner().clean(dirty(spark, sf_dir), "orders").steps_frame().where(F.col("step").isin(wanted)).select("step", "cells")


@query("clean_fill_defaults", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS discount FROM part")
def clean_fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Catalog({"p": contract({"columns": {"p_partkey": {"type": "integer", "required": True}, "discount": {"type": "percent", "default": 0}}})}, _RANGES.weights)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(ROW), "p_partkey", F.when(F.col("p_partkey") % 4 == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("%"))).alias("Discount"))
    return Cleaner(own).clean(rows, "p").data.select("p_partkey", "discount")


@query("clean_remove_duplicates", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(trim(text), '\\s+', ' ', 'g'), lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def clean_remove_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW), "text", F.col("lang"))
    own = Catalog({"d": contract({"columns": {"text": {"type": "string"}, "lang": {"type": "string"}}})}, _RANGES.weights)
    return Cleaner(own).clean(docs, "d").data.select(F.col(ROW).alias("doc_id"))


@query(
    "stream_row_checks",
    "SELECT 'negative_values(value)' AS \"check\", count(*) FILTER (event_id % 3 = 0 AND value <> 0) AS n FROM events",
)
def stream_row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of files: checks of each row, failures counted as they come, until all files are read."""
    import uuid

    from tablewright.streaming.checks import annotate

    own = Catalog({"e": contract({"columns": {"value": {"type": "float", "min": 0}}})}, _RANGES.weights)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = stream.select(F.when(F.col("event_id") % 3 == 0, -F.abs("value")).otherwise(F.abs("value")).alias("value"))
    counts = annotate(events, own, "e").select(F.explode("_failed").alias("check")).groupBy("check").agg(F.count("*").alias("n"))
    name = f"failures_{uuid.uuid4().hex}"  # a row for each check
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
