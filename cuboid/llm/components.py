"""Connected components by alternating large-star and small-star steps (joins and aggregations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.llm.tables import saved


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """A saved table (node, root) for every node of the undirected edges (u, v): root is the smallest node it reaches.

    Loops and repeated edges are allowed; rows with a null end are ignored. Each round halves the paths' depth; the
    minima are pre-aggregated, so that a node with very many edges needs no task of its own."""
    e = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = saved(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _print(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")))
        # large star: larger neighbours move to the smallest one
        big = saved(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).filter("u <> v").distinct(), low, e)
        # small star: smaller neighbours and the node itself move to the smallest one
        low = saved(big.groupBy("u").agg(F.min("v").alias("w")))
        moved = big.join(low, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(low.select("u", F.col("w").alias("v")))
        e = saved(moved.filter("u <> v").distinct(), low, big)
        after = _print(e)
        if after == before:
            break
        before = after
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    return saved(found, e)
