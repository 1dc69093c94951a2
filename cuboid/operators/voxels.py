"""Voxelization: points grouped into grid cells, with caps per cell and per frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid(low: tuple[float, ...], high: tuple[float, ...], size: tuple[float, ...]) -> list[int]:
    """Cells along x, y and z: the extent over the size, halves rounded away from zero."""
    dims = [int(np.floor((np.float32(b) - np.float32(a)) / np.float32(s) + np.float32(0.5))) for a, b, s in zip(low, high, size, strict=True)]
    if min(dims) < 1:
        raise ValueError("a cell is larger than twice the range")
    return dims


def with_cells(points: DataFrame, low: tuple[float, ...], high: tuple[float, ...], size: tuple[float, ...]) -> DataFrame:
    """Finite points within the half-open range, with ix, iy, iz and cell ((iz * ny + iy) * nx + ix). The index is
    worked out in single precision, as the cells are defined."""
    dims = grid(low, high, size)
    for n, a, b in zip("xyz", low, high, strict=True):
        points = points.filter(f"NOT isnan({n}) AND float({n}) >= float({a!r}) AND float({n}) < float({b!r})")
    for n, a, s, d in zip("xyz", low, size, dims, strict=True):
        points = points.withColumn(f"i{n}", F.expr(f"least(cast(float((float({n})-float({a!r}))/float({s!r})) AS int), {d - 1})"))
    return points.withColumn("cell", F.expr(f"(cast(iz AS bigint)*{dims[1]}+iy)*{dims[0]}+ix"))


def voxelize(points: DataFrame, low: tuple[float, ...], high: tuple[float, ...], size: tuple[float, ...], order: list[str], max_points: int = 32, max_voxels: int | None = None) -> DataFrame:
    """Points with cell, slot (0 to max_points - 1, in the order of order) and num_points (of the cell, capped).

    With max_voxels only a frame's lowest cells stay. The caps are the feature; the ranks plan as group limits."""
    rows = with_cells(points, low, high, size)
    cell = Window.partitionBy("frame_id", "cell").orderBy(*order)
    rows = rows.withColumn("slot", F.row_number().over(cell) - 1).filter(F.col("slot") < max_points)
    rows = rows.withColumn("num_points", F.count("*").over(Window.partitionBy("frame_id", "cell")))
    if max_voxels is not None:
        cells = rows.filter("slot = 0").select("frame_id", "cell").withColumn("_k", F.row_number().over(Window.partitionBy("frame_id").orderBy("cell"))).filter(F.col("_k") <= max_voxels)
        rows = rows.join(cells.drop("_k"), ["frame_id", "cell"])
    return rows
