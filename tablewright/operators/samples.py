"""Pieces of sample tables: random columns, rows put in between others, rows numbered in an order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.rows import ROW, numbered


def lognormal(mu: float, sigma: float, seed: int) -> Column:
    """Of which the logarithm is normal."""
    return F.exp(F.randn(seed) * sigma + mu)


def poisson(mean: float, seed: int) -> Column:
    """Counts, by how many steps of the distribution function lie below an even random number. For means up to some hundreds: the
    expression has a step for each count that can come up."""
    drawn, step, below, out = F.rand(seed), math.exp(-mean), 0.0, F.lit(0)
    for k in range(math.ceil(mean + 10 * math.sqrt(mean) + 10)):
        below += step
        out = out + (drawn >= below).cast("int")
        step *= mean / (k + 1)
    return out


def whole_above(c: Column) -> Column:
    """The least whole number that is not below."""
    return F.ceil(c).cast("long")


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows sorted by some columns, nulls last, and numbered anew. Equal rows may come in any order, so the columns should tell rows
    apart."""
    return numbered(df.drop(ROW).orderBy(*[F.col(c).asc_nulls_last() for c in order]))


def insert(df: DataFrame, extra: DataFrame, before: str) -> DataFrame:
    """Numbered rows with the rows of extra put in, each before the row whose number it has in the column `before` (at the end, if
    there is none), and numbered anew. Rows keep their order; extra rows at one place stand in the order of their other columns."""
    columns = [c for c in df.columns if c != ROW]
    old = df.select(F.col(ROW).alias("_at"), F.lit(1).alias("_old"), *[F.col(f"`{c}`") for c in columns])
    new = extra.select(F.col(before).alias("_at"), F.lit(0).alias("_old"), *[F.col(f"`{c}`") for c in columns])
    return in_order(old.unionByName(new), ["_at", "_old", *[f"`{c}`" for c in columns]]).drop("_at", "_old")
