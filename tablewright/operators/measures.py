"""Measures over clean tables: named aggregates, overall or by dimension, as grouping sets of one scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import CalculationFailed
from tablewright.plans.contracts import check_code
from tablewright.plans.settings import Thresholds


@dataclass(frozen=True)
class Measure:
    code: str
    group: str
    unit: str
    inputs: tuple[str, ...]
    formula: Column


REGISTRY: dict[str, Callable[[], Measure]] = {}


def measure(code: str, group: str, unit: str, *inputs: str):
    """Register a function that gives the aggregate column of a measure."""

    def add(build: Callable[[], Column]):
        if check_code(code) in REGISTRY:
            raise CalculationFailed(f"two measures are called {code}")
        REGISTRY[code] = lambda: Measure(code, group, unit, inputs, build())
        return build

    return add


def _ratio(a: Column, b: Column, by: float = 1.0) -> Column:
    return F.try_divide(a * by, b)


GROSS = lambda: F.col("quantity") * F.col("unit_price")
NET = lambda: GROSS() * (1 - F.coalesce(F.col("discount_pct"), F.lit(0.0)) / 100)
COST = lambda: F.col("quantity") * F.col("cost_price")

measure("total_sales", "sales", "currency", "quantity", "unit_price")(lambda: F.sum(GROSS()))
measure("net_sales", "sales", "currency", "quantity", "unit_price", "discount_pct")(lambda: F.sum(NET()))
measure("order_count", "sales", "count", "invoice_no")(lambda: F.count_distinct("invoice_no"))
measure("avg_order_value", "sales", "currency", "quantity", "unit_price", "discount_pct", "invoice_no")(lambda: _ratio(F.sum(NET()), F.count_distinct("invoice_no")))
measure("units_sold", "sales", "count", "quantity")(lambda: F.sum("quantity"))
measure("avg_selling_price", "sales", "currency", "quantity", "unit_price", "discount_pct")(lambda: _ratio(F.sum(NET()), F.sum("quantity")))
measure("stock_quantity", "inventory", "count", "stock_qty", "_latest")(lambda: F.sum(F.when(F.col("_latest"), F.col("stock_qty"))))
measure("stock_value", "inventory", "currency", "stock_qty", "unit_cost", "_latest")(lambda: F.sum(F.when(F.col("_latest"), F.col("stock_qty") * F.col("unit_cost"))))
measure("stock_days", "inventory", "days", "stock_qty", "avg_daily_sales", "_latest")(
    lambda: _ratio(F.sum(F.when(F.col("_latest"), F.col("stock_qty"))), F.sum(F.when(F.col("_latest"), F.col("avg_daily_sales"))))
)
measure("out_of_stock_pct", "inventory", "pct", "stock_qty", "_latest")(
    lambda: _ratio(F.count_if(F.col("_latest") & (F.col("stock_qty") <= Thresholds().stockout_threshold)), F.count_if("_latest"), 100.0)
)
measure("slow_moving_items", "inventory", "count", "last_sale_date", "snapshot_date", "_latest")(
    lambda: F.count_if(F.col("_latest") & (F.datediff("snapshot_date", "last_sale_date") > Thresholds().slow_moving_days))
)
measure("inventory_turnover", "inventory", "ratio", "stock_qty", "unit_cost", "avg_daily_sales", "_latest")(
    lambda: _ratio(F.sum(F.when(F.col("_latest"), F.col("avg_daily_sales") * F.col("unit_cost"))), F.sum(F.when(F.col("_latest"), F.col("stock_qty") * F.col("unit_cost"))), 365.0)
)
measure("total_cost", "margin", "currency", "quantity", "cost_price")(lambda: F.sum(COST()))
measure("gross_profit", "margin", "currency", "quantity", "unit_price", "discount_pct", "cost_price")(lambda: F.sum(NET()) - F.sum(COST()))
measure("gross_margin_pct", "margin", "pct", "quantity", "unit_price", "discount_pct", "cost_price")(lambda: _ratio(F.sum(NET()) - F.sum(COST()), F.sum(NET()), 100.0))
measure("avg_margin_pct", "margin", "pct", "quantity", "unit_price", "discount_pct", "cost_price")(lambda: F.avg(_ratio(NET() - COST(), NET(), 100.0)))
measure("total_requests", "operations", "count", "status")(lambda: F.count_if(F.col("status") != "cancelled"))
measure("completed_requests", "operations", "count", "status")(lambda: F.count_if(F.col("status") == "completed"))
measure("pending_requests", "operations", "count", "status")(lambda: F.count_if(F.col("status").isin("open", "in_progress")))
measure("completion_pct", "operations", "pct", "status")(lambda: _ratio(F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") != "cancelled"), 100.0))
measure("avg_tat_hours", "operations", "hours", "tat_hours")(lambda: F.avg("tat_hours"))
measure("sla_compliance_pct", "operations", "pct", "tat_hours", "sla_hours")(
    lambda: _ratio(F.count_if(F.col("tat_hours") <= F.col("sla_hours")), F.count_if(F.col("tat_hours").isNotNull() & F.col("sla_hours").isNotNull()), 100.0)
)


def latest(df: DataFrame, column: str = "snapshot_date") -> DataFrame:
    """Add whether a row is of the latest snapshot: one value is joined to all rows."""
    last = df.agg(F.max(column).alias("_last"))
    return df.crossJoin(F.broadcast(last)).withColumn("_latest", F.col(column) == F.col("_last")).drop("_last")


def calculate(df: DataFrame, codes: Sequence[str], by: Sequence[str] = (), *, total: bool = False) -> DataFrame:
    """The measures by some columns; with total also over all rows (those columns are then NULL, and _all is true)."""
    if odd := [c for c in codes if c not in REGISTRY]:
        raise CalculationFailed(f"no measure(s) {', '.join(odd)}")
    made = [REGISTRY[c]() for c in codes]
    if any("_latest" in m.inputs for m in made) and "_latest" not in df.columns:
        df = latest(df)
    if gone := sorted({i for m in made for i in m.inputs if i not in df.columns}):
        raise CalculationFailed(f"no column(s) {', '.join(gone)}")
    aggregates = [m.formula.alias(m.code) for m in made]
    if not by:
        return df.agg(*aggregates)
    if total:
        return df.groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]).agg(*aggregates, (F.grouping_id() > 0).alias("_all"))
    return df.groupBy(*by).agg(*aggregates)


def growth(df: DataFrame, date: str, value: Column, start: str, end: str) -> DataFrame:
    """current, previous and growth_pct of a sum over [start, end] and the period of equal length before it."""
    a, b, day = F.lit(start).cast("date"), F.lit(end).cast("date"), F.col(date).cast("date")
    before = F.date_sub(a, F.datediff(b, a) + 1)
    now = F.sum(F.when(day.between(a, b), value)).alias("current")
    then = F.sum(F.when((day >= before) & (day < a), value)).alias("previous")
    return df.where((day >= before) & (day <= b)).agg(now, then).withColumn("growth_pct", F.try_divide((F.col("current") - F.col("previous")) * 100, F.col("previous")))


def enrich(df: DataFrame) -> DataFrame:
    """Sales lines with net sales, cost, margin and period keys."""
    return df.withColumns({"net_sales": NET(), "cost": COST(), "month": F.date_trunc("MONTH", "invoice_date").cast("date"), "week": F.date_trunc("WEEK", "invoice_date").cast("date")}).withColumn(
        "margin_pct", _ratio(F.col("net_sales") - F.col("cost"), F.col("net_sales"), 100.0)
    )


def top(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The n rows of greatest value; equals by all columns."""
    return df.orderBy(F.desc(by), *[c for c in df.columns if c != by]).limit(n)
