"""Sweeps of a moving sensor gathered into one frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuboid.operators.boxes import with_exprs
from cuboid.operators.order import numbered


def last_sweeps(frames: DataFrame, sweeps: DataFrame, n: int, bucket: Column | None = None) -> DataFrame:
    """(frame, sweep, back): for every key sweep the n latest sweeps of its sensor up to it, itself first (back 0).

    frames: sensor, seq of the key sweeps; sweeps: sensor, seq (any order) of all sweeps. bucket: a span of time that
    follows the order of seq, such as its day, so that no task sorts a sensor's whole life."""
    if n < 1:
        raise ValueError("a frame has one sweep at least")
    chain = numbered(sweeps, ["sensor"], F.lit(0) if bucket is None else bucket, ["seq"], "_k")
    keys = frames.join(chain.select("sensor", "seq", "_k"), ["sensor", "seq"]).withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys = keys.select("sensor", F.col("seq").alias("frame"), (F.col("_k") - F.col("back")).alias("_k"), "back")
    return keys.join(chain.withColumnRenamed("seq", "sweep"), ["sensor", "_k"]).drop("_k")


def accumulate(points: DataFrame, poses: DataFrame) -> DataFrame:
    """points (sweep, x, y, z, ...) carried to the key frame by each sweep's pose t00 to t23, with its dt (seconds)."""
    both = points.join(poses, "sweep")
    moved = with_exprs(both, {c: f"t{i}0*x+t{i}1*y+t{i}2*z+t{i}3" for i, c in enumerate("xyz")})
    return moved.drop(*[f"t{i}{j}" for i in range(3) for j in range(4)])
