"""Row checks over streams: what needs no other row runs on each micro-batch; repeats are found within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.checks import BetweenColumns, Context, InvalidCategories, InvalidDates, InvalidNumbers, MissingValues, Ranges, is_part, parsed
from tablewright.functions import names
from tablewright.plans.contracts import Catalog
from tablewright.plans.settings import Validation

ROW_CHECKS = (MissingValues(), InvalidDates(), InvalidNumbers(), InvalidCategories(), Ranges(), BetweenColumns())


def annotate(df: DataFrame, catalog: Catalog, dataset: str, *, dayfirst: bool = True) -> DataFrame:
    """Add the names of the failing row checks of each row. Works on streams and on tables."""
    contract = catalog[dataset]
    ctx = Context(df, contract, names.match(df.columns, contract), Validation(duplicate_check=False, dayfirst=dayfirst))
    found = [f for check in ROW_CHECKS for f in check.findings(ctx) if not isinstance(f.failed, int) and f.invalidates]
    label = lambda f: f"{f.check}({f.column})" if f.column else f.check
    out = parsed(ctx).withColumn("_failed", F.array_compact(F.array(*[F.when(f.failed, label(f)) for f in found])))
    return out.drop(*filter(is_part, out.columns))


def without_repeats(df: DataFrame, time: str, key: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def failures(df: DataFrame, time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Failing rows by check and window of time."""
    each = df.withWatermark(time, delay).select(time, F.explode("_failed").alias("check"))
    return each.groupBy(F.window(time, window), "check").agg(F.count("*").alias("n"))
