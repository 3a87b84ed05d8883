"""Column profiles and type detection: votes of all values instead of samples.

The cells of all columns are first combined by value, in one aggregation; each different value is then looked at once, with the
number of its rows and the first of them, and the votes, the numbers of different values and the samples all come from there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import values
from tablewright.operators.checks import quoted
from tablewright.operators.rows import ROW

#: Shares of values that must agree, and what counts as a category.
NUMERIC_SHARE, DATE_SHARE = 0.95, 0.90
CATEGORY_VALUES, CATEGORY_SHARE, CATEGORY_ROWS = 50, 0.05, 20
#: Words of boolean columns.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n")
SAMPLES = 3


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    detected_type: str
    non_null_count: int
    null_count: int
    null_pct: float
    unique_count: int
    sample_values: tuple[str, ...]


def _parsed(c: Column, k: int, kind: T.DataType) -> dict[str, Column]:
    """Parsed once below the aggregation."""
    if not isinstance(kind, T.StringType):
        return {}
    text = values.strip(c)
    bare = F.regexp_replace(F.regexp_replace(c, ",", ""), rf"%+[{values.WHITE}]*$", "")
    return {f"_text_{k}": text, f"_number_{k}": values.number(bare).value, f"_moment_{k}": values.timestamp(c, dayfirst=False)}


def _votes(c: Column, k: int, kind: T.DataType, approximate: bool) -> dict[str, Column]:
    full = ~values.blank(c, kind)
    out = {"n": F.count_if(full)}
    if approximate:
        out["unique"] = F.approx_count_distinct(F.when(full, c.cast("string")))
    if isinstance(kind, T.NumericType):
        return out | {"whole": F.bool_and(F.when(full, F.pmod(c.cast("double"), F.lit(1.0)) == 0))}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return out | {"clock": F.bool_or(F.date_trunc("DAY", c) != c)}
    if not isinstance(kind, T.StringType):
        return out
    text, number, moment = F.col(f"_text_{k}"), F.col(f"_number_{k}"), F.col(f"_moment_{k}")
    full = F.coalesce(text != "", F.lit(False))
    out = {
        "n": F.count_if(full),
        "words": F.count_if(full & F.lower(text).isin(list(BOOLEAN_WORDS))),
        "numbers": F.count_if(full & number.isNotNull()),
        "percents": F.count_if(full & text.endswith("%")),
        "whole": F.bool_and(F.when(full & number.isNotNull(), F.pmod(number, F.lit(1.0)) == 0)),
        "marks": F.count_if(full & text.rlike(r"[-/.:]|\d\s+[A-Za-z]{3}")),
        "dates": F.count_if(full & moment.isNotNull()),
        "clock": F.bool_or(F.date_trunc("DAY", moment) != moment),
    }
    if approximate:
        out |= {"unique": F.approx_count_distinct(F.when(full, c)), "texts": F.approx_count_distinct(F.when(full, text))}
    return out


def detected(kind: T.DataType, v: dict) -> str:
    """The type that the votes of a column give."""
    n = v["n"]
    if not n:
        return "empty"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime" if v["clock"] else "date"
    if isinstance(kind, T.NumericType):
        return "integer" if v["whole"] else "float"
    if not isinstance(kind, T.StringType):
        return "string"
    if v["words"] == n:
        return "boolean"
    if v["numbers"] / n >= NUMERIC_SHARE:
        if v["percents"] / n >= NUMERIC_SHARE:
            return "percent"
        return "integer" if v["whole"] else "float"
    if v["marks"] / n >= DATE_SHARE and v["dates"] / n >= DATE_SHARE:
        return "datetime" if v["clock"] else "date"
    share = v["texts"] / n
    if n >= CATEGORY_ROWS and ((v["texts"] <= CATEGORY_VALUES and share <= 0.5) or share <= CATEGORY_SHARE):
        return "category"
    return "string"


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """k (the column's number), v, n and first (row) of each different value that is not blank."""
    at = (F.col(ROW) if ROW in df.columns else F.lit(0)).cast("long").alias("at")
    cells = [df.select(F.lit(k).alias("k"), quoted(c).cast("string").alias("v"), at).where(~values.blank(quoted(c), df.schema[c].dataType)) for k, c in enumerate(columns)]
    each = reduce(DataFrame.union, cells)  # a scan of one column each
    return each.groupBy("k", "v").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def _of_values(each: DataFrame, texts: list[int]) -> dict[int, dict]:
    """By column number: n, unique, and the votes of text columns, whose values are parsed once each."""
    is_text, n = F.col("k").isin(texts), F.col("n")
    text = values.strip(F.col("v"))
    bare = F.regexp_replace(F.regexp_replace("v", ",", ""), rf"%+[{values.WHITE}]*$", "")
    held = each.withColumns({"text": F.when(is_text, text), "number": F.when(is_text, values.number(bare).value), "moment": F.when(is_text, values.timestamp(F.col("v"), dayfirst=False))})
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    text, number, moment = F.col("text"), F.col("number"), F.col("moment")
    votes = held.groupBy("k").agg(
        F.sum(n).alias("n"),
        F.count("*").alias("unique"),
        count(F.lower(text).isin(list(BOOLEAN_WORDS))).alias("words"),
        count(number.isNotNull()).alias("numbers"),
        count(text.endswith("%")).alias("percents"),
        F.bool_and(F.when(number.isNotNull(), F.pmod(number, F.lit(1.0)) == 0)).alias("whole"),
        count(text.rlike(r"[-/.:]|\d\s+[A-Za-z]{3}")).alias("marks"),
        count(moment.isNotNull()).alias("dates"),
        F.bool_or(F.date_trunc("DAY", moment) != moment).alias("clock"),
        F.count_if(text != F.col("v")).alias("dressed"),
    )
    out = {r["k"]: r.asDict() for r in votes.collect()}  # a row for each column
    dressed = [k for k, r in out.items() if r["dressed"]]
    for r in out.values():
        r["texts"] = r["unique"]
    if dressed:  # values that are equal when stripped
        rows = each.where(F.col("k").isin(dressed)).select("k", values.strip(F.col("v")).alias("text")).distinct().groupBy("k").agg(F.count("*").alias("n"))
        for r in rows.collect():
            out[r["k"]]["texts"] = r["n"]
    return out


def _firsts(each: DataFrame, order: str, n: int = SAMPLES) -> dict[int, tuple[str, ...]]:
    """By column number: the first n values. Tasks keep n of each column before they shuffle."""
    rows = each.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(order, "v"))).where(F.col("at") <= n)
    out: dict[int, list[str]] = {}
    for r in rows.orderBy("k", "at").collect():  # n rows for each column
        out.setdefault(r["k"], []).append(r["v"])
    return {k: tuple(v) for k, v in out.items()}


def votes(df: DataFrame, approximate: bool = False, with_samples: bool = False) -> tuple[int, dict[str, dict]]:
    """Rows, and the votes of each column (with samples, where they are asked for). Approximate: one aggregation without a shuffle
    of values."""
    columns = [c for c in df.columns if c != ROW]
    kinds = [df.schema[c].dataType for c in columns]
    direct = [k for k, kind in enumerate(kinds) if approximate or not isinstance(kind, T.StringType)]
    asked = {(k, name): col for k in direct for name, col in _votes(quoted(columns[k]), k, kinds[k], approximate).items()}
    plain, df = df, df.withColumns({n: v for k in direct for n, v in _parsed(quoted(columns[k]), k, kinds[k]).items()})
    row = df.agg(F.count("*").alias("n"), *[col.alias(f"v{k}") for k, col in enumerate(asked.values())]).first()
    out: dict[str, dict] = {c: {"n": 0, "unique": 0} for c in columns}
    for at, (k, name) in enumerate(asked):
        out[columns[k]][name] = row[f"v{at}"]
    if not approximate and columns:
        each = _values(plain, columns).persist(StorageLevel.MEMORY_AND_DISK)
        for k, own in _of_values(each, [k for k in range(len(columns)) if k not in direct]).items():
            out[columns[k]] = (own if k not in direct else {"unique": own["unique"]} | out[columns[k]]) | {"unique": own["unique"]}
        if with_samples:
            for k, found in _firsts(each, "first").items():
                out[columns[k]]["samples"] = found
        each.unpersist()
    return row["n"], out


def samples(df: DataFrame, column: str, n: int = SAMPLES) -> tuple[str, ...]:
    """The first distinct values, by row number where there is one, else in order."""
    return _firsts(_values(df.select(*[c for c in df.columns if c in (column, ROW)]), [column]), "first", n).get(0, ())


def profile(df: DataFrame, *, approximate: bool = False, with_samples: bool = True) -> list[ColumnProfile]:
    total, found = votes(df, approximate, with_samples)
    out = []
    for c, v in found.items():
        pct = round((total - v["n"]) / total * 100, 2) if total else 0.0
        out.append(ColumnProfile(c, detected(df.schema[c].dataType, v), v["n"], total - v["n"], pct, v["unique"], (v["samples"] if "samples" in v else samples(df, c) if approximate else ()) if with_samples else ()))
    return out


def empty_rows(df: DataFrame) -> int:
    """Rows of nulls alone; white space is not null here."""
    return df.where(reduce(lambda a, b: a & b, [quoted(c).isNull() for c in df.columns if c != ROW], F.lit(True))).count()


def columns_frame(df: DataFrame, profiles: list[ColumnProfile]) -> DataFrame:
    schema = "name string, detected_type string, non_null_count long, null_count long, null_pct double, unique_count long, sample_values array<string>"
    return df.sparkSession.createDataFrame([(*list(vars(p).values())[:-1], list(p.sample_values)) for p in profiles], schema)
