"""Spatial joins of points and boxes within a frame.

Both sides are dealt by frame and ground cell, so a frame with a large share of all rows is spread over many keys. Cells
come in levels, each four times as wide as the one before: a box lies in the level in which its bounding circle touches
16 cells at most, however large it is. Points are looked up in the levels that boxes have; a pair of boxes meets in the
level of the larger one and counts in the first cell they share. Boxes with a centre or size that is not finite meet
nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuboid.functions import geom
from cuboid.operators.boxes import params

CELL = 8.0  # metres, of the finest level
_INF = float("inf")


def _reach(prefix: str = "") -> Column:
    return F.sqrt(F.col(f"{prefix}l") ** 2 + F.col(f"{prefix}w") ** 2 + F.col(f"{prefix}h") ** 2) / 2


def _level(cell: float, prefix: str = "") -> Column:
    """The level in which a box is at most three cells wide."""
    return F.greatest(F.lit(0), F.ceil(F.log(2 * _reach(prefix) / (3 * cell)) / math.log(4))).cast("int")


def _width(cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(4.0), F.col("_level"))


def _finite(boxes: DataFrame) -> DataFrame:
    """Boxes whose centre and size are numbers."""
    return boxes.filter((F.abs(F.col("cx")) < _INF) & (F.abs(F.col("cy")) < _INF) & (F.abs(F.col("cz")) < _INF) & (_reach() < _INF))


def _levels(cell: float, *boxes: DataFrame) -> Column:
    """The levels of the boxes, worked out as part of the query that uses them."""
    own = reduce(DataFrame.unionByName, [_finite(b).select(_level(cell).alias("_level")) for b in boxes])
    return own.agg(F.collect_set("_level")).scalar()


def _cells(boxes: DataFrame, cell: float, levels: Column | None = None) -> DataFrame:
    """A row per box and cell (_level, gx, gy): of the box's own level, and of coarser ones of levels."""
    boxes = _finite(boxes).withColumn("_level", _level(cell) if levels is None else F.explode(levels)).filter(F.col("_level") >= _level(cell))
    span = lambda c: F.sequence(F.floor((F.col(c) - _reach()) / _width(cell)), F.floor((F.col(c) + _reach()) / _width(cell)))
    return boxes.withColumn("gx", F.explode(span("cx"))).withColumn("gy", F.explode(span("cy")))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of a point and a box that holds it, borders included: all columns of points, and the boxes' columns
    but frame_id, label renamed to box_label."""
    box = _cells(params(boxes), cell)
    box = box.withColumnRenamed("label", "box_label") if "label" in box.columns else box
    pts = points.withColumn("_level", F.explode(_levels(cell, boxes)))
    pts = pts.withColumns({"gx": F.floor(F.col("x") / _width(cell)), "gy": F.floor(F.col("y") / _width(cell))})
    found = pts.join(box, ["frame_id", "_level", "gx", "gy"]).filter(F.expr(geom.contains()))
    return found.drop("_level", "gx", "gy", *[f"r{i}{j}" for i in range(3) for j in range(3)])


def min_points(boxes: DataFrame, points: DataFrame, least: int, cell: float = CELL) -> DataFrame:
    """The boxes that hold at least so many points of their frame."""
    if least < 1:
        return boxes
    full = points_in_boxes(points.select("frame_id", "x", "y", "z"), boxes, cell).groupBy("frame_id", "box_idx").agg(F.count("*").alias("n"))
    return boxes.join(full.filter(F.col("n") >= least).select("frame_id", "box_idx"), ["frame_id", "box_idx"], "left_semi")


def lowest_box(points: DataFrame, boxes: DataFrame, key: list[str], cell: float = CELL) -> DataFrame:
    """points with box_idx: the lowest of the boxes that hold a point, -1 without one. key names a point."""
    hit = points_in_boxes(points.select("frame_id", *key, "x", "y", "z"), boxes, cell).groupBy("frame_id", *key).agg(F.min("box_idx").alias("box_idx"))
    return points.join(hit, ["frame_id", *key], "left").withColumn("box_idx", F.coalesce("box_idx", F.lit(-1).cast("long")))


def near_pairs(a: DataFrame, b: DataFrame, on: list[str] | None = None, cell: float = CELL) -> DataFrame:
    """Pairs of boxes of one frame (and equal columns of on) whose bounding spheres meet, columns prefixed a_ and b_."""
    keys, place = ["frame_id", *(on or [])], ["_level", "gx", "gy"]
    levels, sides = _levels(cell, a, b), []
    for name, df in (("a", a), ("b", b)):
        df = _cells(params(df), cell, levels)
        sides.append(df.select(*keys, *place, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in (*keys, *place)]))
    both = sides[0].join(sides[1], [*keys, *place])
    first = lambda c: F.greatest(*[F.floor((F.col(f"{s}_{c}") - _reach(f"{s}_")) / _width(cell)) for s in "ab"])
    own = (F.col("_level") == F.greatest(_level(cell, "a_"), _level(cell, "b_"))) & (F.col("gx") == first("cx")) & (F.col("gy") == first("cy"))
    apart = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in ("cy", "cz")), (F.col("a_cx") - F.col("b_cx")) ** 2)
    return both.filter(own & (apart <= (_reach("a_") + _reach("b_")) ** 2)).drop(*place)


def overlapping(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Pairs of boxes that overlap (15 separating axes; touching counts)."""
    return near_pairs(a, b, on).filter(F.expr(" AND ".join(geom.separated())))


def aligned_iou(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """near_pairs with iou of the boxes without their angles, pairs of IoU 0 left out."""
    flat = lambda df: df.withColumns({c: F.lit(0.0) for c in ("yaw", "pitch", "roll")})
    return near_pairs(flat(a), flat(b), on).withColumn("iou", F.expr(geom.aligned_iou())).filter("iou > 0")


def oriented_iou(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """near_pairs with volume and iou of the oriented boxes, pairs without common volume left out.

    The common volume comes from the divergence theorem: a third of the sum, over both boxes' faces, of the area
    inside the other box times the face's distance from a common point. Zero-volume boxes have IoU 0."""
    pairs = near_pairs(a, b, on)
    schema = T.StructType([*pairs.schema.fields, T.StructField("volume", T.DoubleType()), T.StructField("iou", T.DoubleType())])
    sides = ["cx", "cy", "cz", "l", "w", "h", *[f"r{i}{j}" for i in range(3) for j in range(3)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.column_stack([batch.column(f"{s}_{c}").to_numpy(zero_copy_only=False) for c in sides]) for s in "ab")
            volume = np.concatenate([common_volumes(x[k : k + 4096], y[k : k + 4096]) for k in range(0, max(len(x), 1), 4096)])
            union = np.prod(x[:, 3:6], axis=1) + np.prod(y[:, 3:6], axis=1) - volume
            iou = np.divide(volume, union, out=np.zeros_like(volume), where=union > 0)
            arrays = [*batch.columns, pa.array(volume), pa.array(iou)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "volume", "iou"])

    return pairs.mapInArrow(run, schema).filter("iou > 0")


def iou(a: DataFrame, b: DataFrame, on: list[str] | None = None, fmt: str = "XYZLWHYPR") -> DataFrame:
    """near_pairs with iou by box format: of axis-aligned boxes and boxes with a yaw in SQL, of those with three angles by
    clipping. A format without pitch and roll ignores such columns."""
    if fmt == "XYZXYZ":
        a, b = (x.withColumns({k: F.expr(v) for k, v in geom.convert(fmt, "XYZLWH").items()}) for x in (a, b))
    if fmt in ("XYZXYZ", "XYZLWH"):
        return aligned_iou(a, b, on)
    return yaw_iou(a, b, on) if fmt == "XYZLWHY" else oriented_iou(a, b, on)


def yaw_iou(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """near_pairs with iou of boxes that have a yaw only, pairs of IoU 0 left out: the common area of turned rectangles in
    SQL, edge by edge (geom.yaw_iou), times the common height. Every step's columns are made by a generator of one row, so
    that neither projections nor the filters on iou repeat the steps before."""
    flat = lambda df: df.withColumns({c: F.lit(0.0) for c in ("pitch", "roll")})
    found = near_pairs(flat(a), flat(b), on)
    made = geom.yaw_iou()
    for step in made:
        found = found.select("*", F.inline(F.array(F.struct(*[F.expr(v).alias(k) for k, v in step.items()]))))
    return found.drop(*[c for step in made[:-1] for c in step]).filter("iou > 0")


def common_volume(p: np.ndarray, q: np.ndarray) -> float:
    """The volume that two boxes (centre, size, rotation row by row) share."""
    return float(common_volumes(p[None], q[None])[0])


def common_volumes(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The volumes that the boxes of two equally long arrays share, row by row. All pairs are clipped at once: every face
    is a row of corners, of which count are in use."""
    origin = p[:, :3].copy()
    sides = [(b[:, :3] - origin, b[:, 3:6] / 2, b[:, 6:].reshape(-1, 3, 3)) for b in (p, q)]
    total = np.zeros(len(p))
    for k, (centre, half, turn) in enumerate(sides):
        other_c, other_h, other_r = sides[1 - k]
        for axis in range(3):
            a, b = (axis + 1) % 3, (axis + 2) % 3
            u, v = turn[:, :, a] * half[:, a, None], turn[:, :, b] * half[:, b, None]
            for sign in (-1.0, 1.0):
                normal = sign * turn[:, :, axis]
                middle = centre + normal * half[:, axis, None]
                face = np.stack([middle - u - v, middle + u - v, middle + u + v, middle - u + v], axis=1)
                count = np.full(len(p), 4)
                for j in range(3):
                    for s in (-1.0, 1.0):
                        n = s * other_r[:, :, j]
                        level = (n * other_c).sum(1) + other_h[:, j]
                        facing = (n * normal).sum(1)
                        # faces in one plane count once: the first box's, if both look the same way
                        flush = (np.abs(np.abs(facing) - 1) < 1e-12) & (np.abs((n * middle).sum(1) - level) < 1e-9)
                        count = np.where(flush & ((k == 1) | (facing < 0)), 0, count)
                        over = np.where(flush[:, None], 0.0, (face * n[:, None]).sum(2) - level[:, None])
                        face, count = _clip(face, count, over)
                fan = np.cross(face[:, 1:-1] - face[:, :1], face[:, 2:] - face[:, :1])
                fan[np.arange(2, face.shape[1])[None] >= count[:, None]] = 0.0
                total += 0.5 * np.abs((fan.sum(1) * normal).sum(1)) * (normal * middle).sum(1) / 3
    return np.maximum(total, 0.0)


def _clip(face: np.ndarray, count: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of polygons (rows of count corners) where over <= 0."""
    n, width = over.shape
    place = np.arange(width)[None]
    used = place < count[:, None]
    after = np.where(place + 1 < count[:, None], place + 1, 0)
    then = np.take_along_axis(over, after, 1)
    crossed = used & (((over < 0) & (then > 0)) | ((then < 0) & (over > 0)))
    part = np.divide(over, over - then, out=np.zeros_like(over), where=crossed)
    point = face + (np.take_along_axis(face, after[:, :, None], 1) - face) * part[:, :, None]
    both = np.stack([face, point], axis=2).reshape(n, 2 * width, 3)
    held = np.stack([used & (over <= 0), crossed], axis=2).reshape(n, 2 * width)
    left = held.sum(1)
    order = np.argsort(~held, axis=1, kind="stable")[:, : max(int(left.max(initial=0)), 3)]
    return np.take_along_axis(both, order[:, :, None], 1), left
