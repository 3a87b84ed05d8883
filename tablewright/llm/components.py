"""Connected components of an edge table, by contraction.

A round gives each node its smallest neighbour (or itself) as parent, jumps pointers until every node points to a local
minimum, and replaces edges by those between minima; at least half of the nodes that still have edges go in each round.
Everything stays in tables: nothing about nodes or edges reaches the driver but counts.

Edges may repeat, in either direction, and may be loops, which link nothing; edges with a null end are left out; no edges give no
rows. Columns other than u and v are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Rows: node, root (the smallest node of its component), for nodes that have edges."""
    spark = edges.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = common.saved_at(df, name)
        paths.append(path)
        return out

    edges = keep(edges.select("u", "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    known = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "parents")
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            jumped = keep(parents.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")), "parents")
            parents = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        pu, pv = (parents.select(F.col("node").alias(k), F.col("root").alias("p" + k)) for k in "uv")
        edges = keep(edges.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        if known is None:
            known = parents
        else:
            step = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            known = keep(known.join(step, "root", "left").select("node", F.coalesce("_up", "root").alias("root")), "components")
    if known is None:
        return spark.createDataFrame([], "node long, root long")
    known, last = common.saved_at(known, "components")
    for path in paths:
        common.drop_table(spark, path)
    return known
