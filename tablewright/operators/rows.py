"""Row numbers and first occurrences, without a window over a whole key.

The first row of each key that repeats is found by an aggregation that combines before it shuffles. Up to SHOWN such keys come
to the driver once and are broadcast, so the rows themselves are not shuffled, however wide they are and however often the plan
is run. Beyond that, the (at most HOT_KEYS) most frequent keys are broadcast and the other rows meet their first row in a shuffle
join; rows that have nothing to look up are spread over its partitions by their number.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_source_row"
#: Rows of an aggregate that are collected and broadcast (a few longs each); the most frequent keys of a shuffle join that are
#: broadcast, and the rows from which a key counts as frequent.
SHOWN, HOT_KEYS, HOT_ROWS = 100_000, 1000, 100_000


def numbered(df: DataFrame, name: str = ROW) -> DataFrame:
    """Rows numbered from 1 in their present order: the place in the partition plus the rows of earlier partitions. One count
    job over the partitions, whose result has a row for each; no shuffle of rows. What a shuffle has dealt out is laid down first."""
    if name in df.columns:
        return df
    df = laid(df)
    placed = df.withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    counts = sorted((r["_pid"], r["n"]) for r in placed.groupBy("_pid").agg(F.count("*").alias("n")).collect())
    base, total = [], 0
    for pid, n in counts:
        base.append((pid, total - (pid << 33) + 1))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(base, "_pid int, _base long"))
    return placed.join(offsets, "_pid", "left").select((F.col("_at") + F.col("_base")).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def digest(columns: Sequence[Column]) -> tuple[Column, Column]:
    """128 bits of some values, as two longs; NULL differs from every value. Each value is read more than once."""
    gone = [c.isNull().cast("long") * F.lit(1 << (k % 62)) for k, c in enumerate(columns)]
    masks = [reduce(lambda a, b: a + b, gone[k : k + 62]) for k in range(0, len(gone), 62)]
    return F.xxhash64(*masks, *columns), F.xxhash64(F.lit("salt"), *masks, *columns)


def bounded(df: DataFrame, most: int | None = None) -> DataFrame | None:
    """df as a table of the driver, to be broadcast, if it has no more rows than most (SHOWN). One job."""
    most = SHOWN if most is None else most
    rows = df.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= most else None


def durable(df: DataFrame) -> DataFrame:
    """Checkpointed, where the session has a checkpoint folder."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df


def laid(df: DataFrame) -> DataFrame:
    """df with partitions that are the same in each job. Those of a shuffle are not: each run draws its own sample for the bounds of
    a sort, and merges small partitions by their bytes. Its rows are written once, where the session has a checkpoint folder, and
    else kept by the executors, where a loss fails loudly."""
    if not re.search(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()):
        return df
    kept = durable(df)
    return df.localCheckpoint() if kept is df else kept


class Repeats:
    """The first rows of the keys that repeat: several kinds of key, by name, in one aggregation over a table."""

    def __init__(self, base: DataFrame, keys: dict[str, tuple[Sequence[Column], Column | None]], row: str = ROW) -> None:
        self.keys, self.row = keys, row
        cells, parts = [], {}
        for k, (key, among) in enumerate(keys.values()):
            parts |= {f"_{k}_{j}": c for j, c in enumerate(key)} | ({f"_{k}_use": among} if among is not None else {})
            a, b = digest([F.col(f"_{k}_{j}") for j in range(len(key))])
            own = F.struct(F.lit(k).alias("_i"), a.alias("_a"), b.alias("_b"))
            cells.append(own if among is None else F.when(F.col(f"_{k}_use"), own))
        narrow = base.select(F.col(row).alias("_row"), *[c.alias(n) for n, c in parts.items()])  # each part is computed once
        each = narrow.select("_row", F.explode(F.array(*cells)).alias("_x")).where("_x is not null").select("_row", "_x.*")
        first = each.groupBy("_i", "_a", "_b").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        small = bounded(first)
        self.small, self.first = small is not None, durable(first) if small is None else small
        self.met = {r["_i"] for r in small.select("_i").distinct().collect()} if self.small else set(range(len(keys)))

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        """Add whether an earlier row has the same key (of the kind of that name)."""
        k = list(self.keys).index(name)
        if k not in self.met:
            return df.withColumn(name, F.lit(False))
        key, among = self.keys[name]
        among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
        held = {f"_part_{j}": c for j, c in enumerate(key)}
        a, b = digest([F.col(n) for n in held])
        out = df.withColumns(held | {"_live": among}).withColumns({"_key_a": a, "_key_b": b}).drop(*held)
        first = self.first.where(F.col("_i") == k).select("_a", "_b", "_first", "_n")
        on = (F.col("_key_a") == F.col("_a")) & (F.col("_key_b") == F.col("_b")) & F.col("_live")
        if self.small:
            out = out.join(F.broadcast(first.drop("_n")), on, "left")
        else:
            hot = bounded(first.where(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n"), "_a", "_b").limit(HOT_KEYS), HOT_KEYS)
            hot = hot.select(F.col("_a").alias("_hot_a"), F.col("_b").alias("_hot_b"), F.col("_first").alias("_hot"))
            out = out.join(F.broadcast(hot), (F.col("_key_a") == F.col("_hot_a")) & (F.col("_key_b") == F.col("_hot_b")) & F.col("_live"), "left")
            live = F.col("_live") & F.col("_hot").isNull()
            out = out.withColumns({"_live": live, "_key_a": F.when(live, F.col("_key_a")).otherwise(F.xxhash64(self.row)), "_key_b": F.when(live, F.col("_key_b")).otherwise(0)})
            out = out.join(first.drop("_n"), on, "left").withColumn("_first", F.coalesce("_hot", "_first")).drop("_hot_a", "_hot_b", "_hot")
        return out.withColumn(name, F.coalesce(F.col("_first") < F.col(self.row), F.lit(False))).drop("_key_a", "_key_b", "_live", "_a", "_b", "_first")


def repeats(df: DataFrame, key: Sequence[Column], name: str, among: Column | None = None, row: str = ROW, base: DataFrame | None = None) -> DataFrame:
    """Add whether an earlier row (of those among) has the same key. base: a cheaper frame with the same rows."""
    return Repeats(df if base is None else base, {name: (key, among)}, row).mark(df, name)
