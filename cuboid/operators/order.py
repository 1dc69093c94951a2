"""Positions of rows within large groups, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096  # rows of a bucket, about


def numbered(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], name: str, sizes: DataFrame | None = None) -> DataFrame:
    """df with name, each row's position from 0 among the rows of the same keys, by bucket and then by order.

    Rows are sorted within a bucket only; the rows of earlier buckets are counted, so that a group with a third of all rows
    is spread over many tasks. bucket: any orderable column; it should have few thousand rows a value. sizes: keys, _bucket
    and _size, the rows of every bucket, where they are known."""
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size")) if sizes is None else sizes
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_within", within).join(sizes, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def hash_bucket(df: DataFrame, keys: Sequence[str], u: Column) -> tuple[DataFrame, Column]:
    """df with the size of each row's group as _n, and the bucket of a number u in [0, 1), so many per group that a bucket
    has about BUCKET rows."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return df.join(sizes, list(keys)), F.floor(u * F.ceil(F.col("_n") / BUCKET))


def quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, cells: int = 1024) -> DataFrame:
    """keys and value: the exact q-quantile of a finite column in every group, linear between neighbours.

    Values are counted in equal cells between a group's least and largest, and again within the cell that holds the rank, so
    that only the rows of that cell are sorted."""
    if not 0 <= q <= 1:
        raise ValueError("q lies within 0 and 1")
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    ends = ends.withColumn("_at", (F.col("_n") - 1) * F.lit(q))
    cell = lambda: F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells), F.lit(cells - 1))
    rows = df.select(*keys, value).join(ends, list(keys)).withColumn("_cell", F.when(F.col("_hi") > F.col("_lo"), cell()).otherwise(F.lit(0)))
    sizes = rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_size"), F.first("_at").alias("_at"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    # a rank and the one after it: both lie in cells that hold them
    sizes = sizes.filter((F.col("_before") <= F.floor("_at") + 1) & (F.col("_before") + F.col("_size") > F.floor("_at"))).select(*keys, "_cell", "_before")
    rank = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(value)) - 1 + F.col("_before")
    near = rows.join(sizes, [*keys, "_cell"]).withColumn("_rank", rank).filter((F.col("_rank") >= F.floor("_at")) & (F.col("_rank") <= F.floor("_at") + 1))
    low = F.max(F.when(F.col("_rank") == F.floor("_at"), F.col(value)))
    high = F.max(F.when(F.col("_rank") == F.floor("_at") + 1, F.col(value)))
    part = F.max(F.col("_at") - F.floor("_at"))
    return near.groupBy(*keys).agg((low + part * (F.coalesce(high, low) - low)).alias(value))
