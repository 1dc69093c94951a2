"""Greedy operators as rounds of joins: the results of one-by-one greedy loops, without gathering a frame in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.plans.tables import drop, saved


def suppress(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that a greedy loop keeps: best first, each kept one suppressing its neighbours; suppressed nodes
    suppress nothing. nodes: id, rank (unique, smaller is better); edges: (better, worse) ids.

    A node is kept once all better neighbours are suppressed, so a round settles whole layers at a time."""
    edges = saved(edges.select("better", "worse").distinct())
    kept = nodes.join(edges.select(F.col("worse").alias("id")).distinct(), "id", "left_anti")  # nothing is better
    done = [saved(kept.select("id"))]
    while True:
        gone = saved(edges.join(done[-1].withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct())
        if not gone.take(1):
            break
        touched = edges.join(gone.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct()
        left = saved(edges.join(gone.withColumnRenamed("id", "worse"), "worse", "left_anti").join(gone.withColumnRenamed("id", "better"), "better", "left_anti"))
        free = touched.join(gone, "id", "left_anti").join(left.select(F.col("worse").alias("id")).distinct(), "id", "left_anti")
        done.append(saved(free.select("id"), edges, gone))
        edges = left
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return nodes.join(out.distinct(), "id", "left_semi")


def assign(edges: DataFrame) -> DataFrame:
    """The pairs of a greedy loop in which every left node, best rank first, takes its best right node still free.

    edges: left, right, rank (of left, unique, smaller is better), value (smaller is better), tie (of right).
    Left nodes propose to their best right node; that keeps the best-ranked proposer, and all worse ones lose it. As
    every right node prefers by the same rank, this settles on the loop's result."""
    edges = saved(edges.select("left", "right", "rank", "value", "tie"))
    while True:
        best = edges.groupBy("left").agg(F.min_by(F.struct("right", "rank"), F.struct("value", "tie", "right")).alias("b"))
        held = saved(best.select("left", "b.right", "b.rank").groupBy("right").agg(F.min("rank").alias("top")))
        lost = edges.join(held, "right").filter("rank > top")
        if not lost.take(1):
            drop(held)
            return edges.join(best.select("left", "b.right"), ["left", "right"])
        edges = saved(edges.join(held, "right", "left").filter("top IS NULL OR rank <= top").drop("top"), edges, held)
