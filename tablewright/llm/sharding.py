"""Proportional stratified interleaving: every shard has the mixture of sources of the whole table.

Rows are ranked by a seeded hash within their source; a row's fractional rank is (rank + 1/2) / rows of the source.
Sorted by fractional rank, any run of rows has each source in proportion, so the sorted rows are cut into shards of equal
counts (at most one apart). Ranks come from range partitions and their counts, so that a source with a third of all rows
is spread like any other.

A null source is a source of its own; a null text has no bytes; repeated rows, and equal texts, get places of their own and are
not kept together (law `rows`: the counts of shards differ by one at most). Rows with a null doc_id are placed like others; rows
that tie in source, hash, doc_id and text take each other's places. Shards of a table with fewer rows than shards are empty where
no row falls into them; an empty table gives no rows. Columns other than doc_id, text and the source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common

SHARDS, SEED = 40, 17


def interleave(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, source: str = "source") -> DataFrame:
    """Rows: doc_id, source, size, text_crc32, shard, slot."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", F.col(source).alias("source"), (F.length(data).cast("long") + 16).alias("size"), F.crc32(data).alias("text_crc32")
    ).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    ranks = common.ranked(rows, ["source"], ["_h", "doc_id", "text_crc32"], "_rank")
    ranks = common.saved(ranks, "source-ranks")
    sizes = ranks.groupBy("source").agg(F.count("*").alias("_n")).withColumnRenamed("source", "_source")
    frac = ranks.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_frac", (F.col("_rank") + 0.5) / F.col("_n"))
    order = frac.select("doc_id", "source", "size", "text_crc32", "_frac", "_h")
    placed = common.ranked(order, [], ["_frac", "_h", "doc_id", "text_crc32"], "_pos")
    total = ranks.count()
    shard = F.expr(f"(_pos * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_pos") - first).select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )


def op7_proportional_sharding(spark, sf_dir: str) -> DataFrame:
    placed = interleave(common.read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
