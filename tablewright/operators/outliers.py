"""Outliers of a series, by group: interquartile range, z-score, deviation from a rolling mean, change from the last value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.rows import bounded, durable
from tablewright.plans.settings import Anomaly


def _with_stats(df: DataFrame, by: Sequence[str], *stats) -> DataFrame:
    """Group statistics beside each row: aggregated first, so that a large group is combined before it is shuffled. A bounded
    number of groups is broadcast; more are joined from a checkpoint, so that adaptive execution can split a large group."""
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*stats)))
    found = df.groupBy(*by).agg(*stats)
    renamed = found.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in found.columns if c not in by])
    small = bounded(renamed)
    renamed = durable(renamed) if small is None else F.broadcast(small)
    on = [df[c].eqNullSafe(renamed[f"_by_{c}"]) for c in by]
    return df.join(renamed, on).drop(*[f"_by_{c}" for c in by])


def iqr(df: DataFrame, value: str, by: Sequence[str] = (), settings: Anomaly | None = None, *, exact: bool = True) -> DataFrame:
    """Add low, high and is_anomaly; percentiles are exact, or approximate for groups that do not fit in memory."""
    s = settings or Anomaly()
    p = (lambda q: F.percentile(value, F.lit(q))) if exact else (lambda q: F.percentile_approx(value, q, 10_000))
    out = _with_stats(df, by, p(0.25).alias("_q1"), p(0.75).alias("_q3"), F.count(value).alias("_n"))
    room = (F.col("_q3") - F.col("_q1")) * s.iqr_multiplier
    out = out.withColumns({"low": F.col("_q1") - room, "high": F.col("_q3") + room})
    hit = (F.col("_n") >= s.min_observations) & ((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))
    return out.withColumn("is_anomaly", F.coalesce(hit, F.lit(False))).drop("_q1", "_q3", "_n")


def zscore(df: DataFrame, value: str, by: Sequence[str] = (), settings: Anomaly | None = None) -> DataFrame:
    """Add zscore (by the sample deviation) and is_anomaly."""
    s = settings or Anomaly()
    out = _with_stats(df, by, F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n"))
    out = out.withColumn("zscore", F.try_divide(F.col(value) - F.col("_m"), F.nullif("_s", F.lit(0.0))))
    return out.withColumn("is_anomaly", F.coalesce((F.col("_n") >= s.min_observations) & (F.abs("zscore") > s.zscore_threshold), F.lit(False))).drop("_m", "_s", "_n")


def rolling(df: DataFrame, value: str, order: str, by: Sequence[str] = (), settings: Anomaly | None = None) -> DataFrame:
    """Add the mean of the last values before a row, the deviation from it in per cent, and is_anomaly."""
    s = settings or Anomaly()
    w = Window.partitionBy(*by).orderBy(order)
    back = w.rowsBetween(-s.rolling_window, -1)
    out = df.withColumns({"expected": F.avg(value).over(back), "_n": F.count(value).over(back)})
    out = out.withColumn("deviation_pct", F.try_divide((F.col(value) - F.col("expected")) * 100, F.abs(F.nullif("expected", F.lit(0.0)))))
    hit = (F.col("_n") >= min(s.min_observations, s.rolling_window)) & (F.abs("deviation_pct") > s.rolling_threshold_pct)
    return out.withColumn("is_anomaly", F.coalesce(hit, F.lit(False))).drop("_n")


def pct_change(df: DataFrame, value: str, order: str, by: Sequence[str] = (), settings: Anomaly | None = None) -> DataFrame:
    """Add the change from the row before in per cent, and is_anomaly."""
    s = settings or Anomaly()
    last = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    out = df.withColumn("change_pct", F.try_divide((F.col(value) - last) * 100, F.abs(F.nullif(last, F.lit(0.0)))))
    return out.withColumn("is_anomaly", F.coalesce(F.abs("change_pct") > s.pct_change_threshold, F.lit(False)))


#: Detectors by name, and whether they follow an order.
METHODS: dict[str, tuple[Callable[..., DataFrame], bool]] = {"iqr": (iqr, False), "zscore": (zscore, False), "rolling": (rolling, True), "pct_change": (pct_change, True)}


def detector(name: str, *, ordered: bool = False):
    """Register a detector: a function of the table, the value, [the order,] the groups and the settings."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        METHODS[name] = (f, ordered)
        return f

    return add


def detect(df: DataFrame, value: str, order: str, by: Sequence[str] = (), settings: Anomaly | None = None, method: str | None = None) -> DataFrame:
    """By the method named, else that of the settings."""
    s = settings or Anomaly()
    found, ordered = METHODS[method or s.method]
    return found(df, value, order, by, s) if ordered else found(df, value, by, s)
