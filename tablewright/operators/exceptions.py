"""Business exceptions: codes of the thresholds that a row crosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.measures import COST, NET, _ratio
from tablewright.plans.settings import Thresholds


def _codes(df: DataFrame, found: dict[str, Column]) -> DataFrame:
    return df.withColumn("exceptions", F.array_compact(F.array(*[F.when(hit, code) for code, hit in found.items()])))


def sales(df: DataFrame, t: Thresholds | None = None) -> DataFrame:
    t = t or Thresholds()
    found = {"high_discount": F.col("discount_pct") > t.max_discount_percent}
    if not t.zero_price_allowed:
        found["zero_price"] = F.col("unit_price") == 0
    if not t.negative_sales_allowed:
        found["negative_sales"] = F.col("quantity") * F.col("unit_price") < 0
    if "cost_price" in df.columns:
        margin = _ratio(NET() - COST(), NET(), 100.0)
        found["low_margin"] = (margin < t.minimum_margin_percent) & (margin >= 0)
        if not t.negative_margin_allowed:
            found["negative_margin"] = margin < 0
    return _codes(df, found)


def inventory(df: DataFrame, t: Thresholds | None = None) -> DataFrame:
    t = t or Thresholds()
    cover = F.try_divide(F.col("stock_qty").cast("double"), F.nullif(F.col("avg_daily_sales"), F.lit(0.0)))
    found = {
        "stockout": F.col("stock_qty") <= t.stockout_threshold,
        "low_stock": (F.col("stock_qty") > t.stockout_threshold) & (cover < t.low_stock_days),
        "overstock": cover > t.overstock_days,
        "slow_moving": F.datediff("snapshot_date", "last_sale_date") > t.slow_moving_days,
    }
    return _codes(df, found)


def orders(df: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """Needs order_value; with status and age_hours also finds requests that wait too long."""
    t = t or Thresholds()
    found = {"high_value": F.col("order_value") >= t.high_value_threshold}
    if {"status", "age_hours"} <= set(df.columns):
        found["long_pending"] = F.col("status").isin("open", "in_progress") & (F.col("age_hours") > t.pending_age_warning_hours)
    return _codes(df, found)


def histogram(df: DataFrame) -> DataFrame:
    """exception, n."""
    return df.select(F.explode("exceptions").alias("exception")).groupBy("exception").agg(F.count("*").alias("n"))
