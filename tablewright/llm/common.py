"""Shared plumbing: durable intermediate tables, gapless ranks, text access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or None
    if found is None:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            found = jdir.get()
        else:
            found = "file://" + tempfile.mkdtemp(prefix="tablewright-")
            atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{work_dir(spark)}/tablewright/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session has ended; the folder goes with the application's shared folder
            return


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no returned frame reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made[:] = [x for x in _made if x[1] != path]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors."""
    return saved_at(df, name)[0]


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """saved(), with the path."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add the gapless rank from 0 of each row among the rows of its keys, by order.

    No window over a whole key: rows are range-partitioned by (keys, order), so that a hot key spreads over
    many partitions; a rank is the number of rows of the key in earlier partitions plus the place in this one.
    Layout and places are written before they are counted, so a retried task cannot change them. Rows that tie
    in the whole order get different ranks, in no stated order.
    """
    spark = df.sparkSession
    cols = [*keys, *order]
    laid = (
        df.repartitionByRange(partitions(spark), *cols)
        .sortWithinPartitions(*cols)
        .withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    laid = saved(laid, f"ranked-{out}")
    counts = laid.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    if not keys:  # one row for each partition
        rows = sorted((r["_pid"], r["_n"], r["_first"]) for r in counts.collect())
        before = np.concatenate([[0], np.cumsum([r[1] for r in rows], dtype=np.int64)])
        base = [(int(r[0]), int(b - r[2])) for r, b in zip(rows, before, strict=False)]
        bases = spark.createDataFrame(base, "_pid int, _base long")
        joined = laid.join(F.broadcast(bases), "_pid")
    else:
        before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        bases = counts.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_pid").alias("_p"),
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
        )
        on = laid["_pid"] == bases["_p"]
        for i, k in enumerate(keys):
            on = on & laid[k].eqNullSafe(bases[f"_k{i}"])
        joined = laid.join(bases, on).drop("_p", *[f"_k{i}" for i in range(len(keys))])
    return joined.withColumn(out, F.col("_base") + F.col("_at")).drop("_pid", "_at", "_base")


def lowest(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The n rows with the lowest hash of the key: a bounded sample that does not depend on the layout. A first count keeps what
    tasks send for it to a few times n rows in all, however many tasks there are, unless most rows repeat a few keys (then a task
    sends n rows at most)."""
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 30))
    total = df.count()
    if total > 8 * n:
        under = h < int((1 << 30) * 4 * n / total) + 1
        if df.where(under).limit(n).count() == n:
            df = df.where(under)
    return df.orderBy(h, *key).limit(n)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def ready(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster it is installed or sent with --py-files."""
    top, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [top, env.get("PYTHONPATH")]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
