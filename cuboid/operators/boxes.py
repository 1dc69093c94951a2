"""Operators on single boxes and points: parameters, corners, moves, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.functions import geom


def with_exprs(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """df with columns computed at once from SQL (all of them see the old values)."""
    return df.withColumns({k: F.expr(v) for k, v in exprs.items() if v != k})


def params(boxes: DataFrame, fmt: str = "XYZLWHYPR") -> DataFrame:
    """boxes with centre, size, all three angles and r00 to r22 (the axes are columns), worked out once a box and before
    any join. Boxes of corners get centre and size; angles that a format lacks are 0, columns of theirs are ignored."""
    if fmt == "XYZXYZ":
        boxes = boxes.withColumns({k: F.expr(v) for k, v in geom.convert(fmt, "XYZLWH").items()})
    boxes = boxes.withColumns({c: F.lit(0.0) for c in geom.BOX[6:] if c not in geom.columns(fmt)})
    angles = [c if c in geom.columns(fmt) else "0.0D" for c in geom.BOX[6:]]
    return with_exprs(boxes, geom.rotation(*angles))


def corners(boxes: DataFrame) -> DataFrame:
    """A row per box and corner: corner (0 to 7), x, y, z."""
    with_r = params(boxes)
    items = [F.struct(F.lit(k).alias("corner"), *[F.expr(e).alias(n) for n, e in zip("xyz", geom.corner(k), strict=True)]) for k in range(8)]
    return with_r.withColumn("_c", F.explode(F.array(*items))).select(*boxes.columns, "_c.*")


def convert(boxes: DataFrame, source: str, target: str) -> DataFrame:
    """boxes with the target format's columns in place of the source's."""
    exprs = geom.convert(source, target)
    rest = [c for c in boxes.columns if c not in geom.convert(source, source)]
    return boxes.select(*rest, *[F.expr(v).alias(k) for k, v in exprs.items()])


def flip_boxes(boxes: DataFrame, axis: str, fmt: str = "XYZLWHYPR") -> DataFrame:
    return with_exprs(boxes, geom.flip(axis, fmt))


def translate_boxes(boxes: DataFrame, offset: tuple[float, float, float], fmt: str = "XYZLWHYPR") -> DataFrame:
    return with_exprs(boxes, geom.translate(offset, fmt))


def scale_boxes(boxes: DataFrame, factor: float, fmt: str = "XYZLWHYPR") -> DataFrame:
    """Centres and sizes, or both corners, grow; angles stay."""
    return scale(boxes, factor, geom.columns(fmt)[:6])


def score_filter(boxes: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Boxes with a score of least or more; a box without a score goes."""
    return boxes.filter(F.col(score) >= least)


def class_filter(boxes: DataFrame, labels: Sequence[int], label: str = "label") -> DataFrame:
    """Boxes of the given classes."""
    return boxes.filter(F.col(label).isin(*labels))


def flip_points(points: DataFrame, axis: str) -> DataFrame:
    return with_exprs(points, {axis: f"-{axis}"})


def translate(df: DataFrame, offset: tuple[float, float, float], names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    return with_exprs(df, {n: f"{n}+({o!r})" for n, o in zip(names, offset, strict=True)})


def scale(df: DataFrame, factor: float, names: tuple[str, ...]) -> DataFrame:
    """Points scale in x, y, z; boxes in their centre and size."""
    if factor <= 0:
        raise ValueError("a scale is positive")
    return with_exprs(df, {n: f"{n}*({factor!r})" for n in names})


def rotate_points(points: DataFrame, axis: tuple[float, float, float], angle: float) -> DataFrame:
    return with_exprs(points, geom.rotate_point(geom.axis_rotation(axis, angle)))


def rotate_boxes(boxes: DataFrame, axis: tuple[float, float, float], angle: float, fmt: str = "XYZLWHYPR") -> DataFrame:
    return with_exprs(boxes, geom.rotate_boxes(axis, angle, fmt))


def range_filter(df: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Rows with low <= value < high on all axes; boxes are tested by their centre (cx, cy, cz), labels go with them."""
    for n, a, b in zip(names, low, high, strict=True):
        df = df.filter((F.col(n) >= a) & (F.col(n) < b))
    return df
