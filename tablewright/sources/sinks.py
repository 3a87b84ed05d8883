"""Sinks: delimited files and Parquet by Spark, workbooks of bounded results."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from tablewright.errors import SinkError
from tablewright.sources import workbook

#: Rows that a sheet may have.
SHEET_ROWS = 100_000


WRITERS: dict[str, Callable[..., None]] = {}


def sink(kind: str):
    """Register a writer: a function of a table, a path and options."""

    def add(f: Callable[..., None]) -> Callable[..., None]:
        WRITERS[kind] = f
        return f

    return add


def write(kind: str, df: DataFrame, path: str, **options: Any) -> None:
    if kind not in WRITERS:
        raise SinkError(f"no sink {kind!r}; there are {', '.join(sorted(WRITERS))}")
    WRITERS[kind](df, path, **options)


@sink("csv")
def to_csv(df: DataFrame, path: str, *, mode: str = "overwrite", header: bool = True) -> None:
    df.write.mode(mode).option("header", header).csv(path)


@sink("parquet")
def to_parquet(df: DataFrame, path: str, *, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def to_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Tables that fit into sheets; a larger one is an error, not cut."""
    made = {}
    for name, df in sheets.items():
        rows = df.limit(SHEET_ROWS + 1).collect()
        if len(rows) > SHEET_ROWS:
            raise SinkError(f"{name} has over {SHEET_ROWS:,} rows")
        made[name] = (df.columns, [tuple(r) for r in rows])
    workbook.write(path, made)


@sink("xlsx")
def to_sheet(df: DataFrame, path: str, *, sheet: str = "Sheet1") -> None:
    to_workbook({sheet: df}, path)


for _format in ("orc", "json"):
    WRITERS[_format] = lambda df, path, *, mode="overwrite", by=(), _format=_format: df.write.mode(mode).partitionBy(*by).format(_format).save(path)
