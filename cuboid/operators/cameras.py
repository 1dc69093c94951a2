"""Cameras: projection, field of view, and intrinsics under image operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.functions import geom
from cuboid.operators.boxes import with_exprs

RIG = 1 << 12  # cameras that all frames share; they are broadcast

#: Camera axes of an unturned camera: x right, y down, z ahead, in a frame with x ahead, y left, z up.


def extrinsics(cams: DataFrame) -> DataFrame:
    """cams with e00 to e23 (frame to camera) of cameras at the origin that look along cam_yaw."""
    rows = {"e00": "sin(cam_yaw)", "e01": "-cos(cam_yaw)", "e02": "0.0D", "e03": "0.0D", "e10": "0.0D", "e11": "0.0D", "e12": "-1.0D", "e13": "0.0D"}
    return with_exprs(cams, rows | {"e20": "cos(cam_yaw)", "e21": "sin(cam_yaw)", "e22": "0.0D", "e23": "0.0D"})


def project(points: DataFrame, cams: DataFrame) -> DataFrame:
    """Every point in every camera of cams: u, v, depth. Where depth <= 0, u and v are NaN. Cameras are joined on
    frame_id where cams has one; otherwise they are a rig that all frames share, of at most RIG cameras."""
    if "frame_id" in cams.columns:
        both = points.join(cams, "frame_id")
    else:
        if cams.limit(RIG + 1).count() > RIG:
            raise ValueError(f"a rig that all frames share has at most {RIG} cameras; give others a frame_id")
        both = points.crossJoin(F.broadcast(cams))
    for k, name in enumerate(("_px", "_py", "depth")):
        both = both.withColumn(name, F.expr(f"e{k}0*x+e{k}1*y+e{k}2*z+e{k}3"))
    seen = F.col("depth") > 0
    u = F.when(seen, F.expr("(fx*_px+skew*_py)/CASE WHEN depth > 0 THEN depth ELSE 1.0D END+cx0")).otherwise(F.lit(float("nan")))
    v = F.when(seen, F.expr("fy*_py/CASE WHEN depth > 0 THEN depth ELSE 1.0D END+cy0")).otherwise(F.lit(float("nan")))
    return both.withColumns({"u": u, "v": v}).drop("_px", "_py")


def in_view(projected: DataFrame, edge: float = 0.0) -> DataFrame:
    """Projected points ahead of the camera and within its image. The right and lower borders lie outside, and with edge
    whatever is less than so many pixels from them, so that rounding does not bring a point on the border in."""
    if edge < 0:
        raise ValueError("edge is not negative")
    within = lambda c, size: (F.col(c) >= 0) & (F.col(c) <= F.col(size) - F.lit(edge) if edge else F.col(c) < F.col(size))
    return projected.filter((F.col("depth") > 0) & within("u", "img_w") & within("v", "img_h"))


def resize(cams: DataFrame, width: int, height: int) -> DataFrame:
    x, y = f"{width}/cast(img_w AS double)", f"{height}/cast(img_h AS double)"
    return with_exprs(cams, {"fx": f"fx*{x}", "skew": f"skew*{x}", "cx0": f"cx0*{x}", "fy": f"fy*{y}", "cy0": f"cy0*{y}", "img_w": f"{width}", "img_h": f"{height}"})


def crop(cams: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    return with_exprs(cams, {"cx0": f"cx0-{left}", "cy0": f"cy0-{top}", "img_w": f"{width}", "img_h": f"{height}"})


def center_crop(cams: DataFrame, height: int, width: int) -> DataFrame:
    """The middle of the image; odd margins give the smaller half to the top and left."""
    return with_exprs(cams, {"cx0": f"cx0-floor((img_w-{width})/2)", "cy0": f"cy0-floor((img_h-{height})/2)", "img_w": f"{width}", "img_h": f"{height}"})


def pad(cams: DataFrame, padding: int | tuple[int, ...]) -> DataFrame:
    """padding: one number, (left and right, top and bottom), or (left, top, right, bottom)."""
    p = (padding,) * 4 if isinstance(padding, int) else tuple(padding)
    p = p * 4 if len(p) == 1 else p * 2 if len(p) == 2 else p
    if len(p) != 4:
        raise ValueError("padding has 1, 2 or 4 numbers")
    return with_exprs(cams, {"cx0": f"cx0+{p[0]}", "cy0": f"cy0+{p[1]}", "img_w": f"img_w+{p[0] + p[2]}", "img_h": f"img_h+{p[1] + p[3]}"})


def resized_crop(cams: DataFrame, top: int, left: int, height: int, width: int, new_width: int, new_height: int) -> DataFrame:
    return resize(crop(cams, top, left, height, width), new_width, new_height)


def flip_image(cams: DataFrame, axis: str) -> DataFrame:
    """Intrinsics and extrinsics of a mirrored image of the mirrored world: h mirrors world y and camera x, v world z
    and camera y, so that extrinsics stay rotations."""
    row, col, centre = {"h": (0, 1, {"cx0": "img_w-cx0"}), "v": (1, 2, {"cy0": "img_h-cy0"})}[axis]
    signs = {f"e{i}{j}": f"-e{i}{j}" for i in range(3) for j in range(4) if (i == row) != (j == col)}
    return with_exprs(cams, centre | {"skew": "-skew"} | {k: v for k, v in signs.items() if k in cams.columns})


def _cells(of) -> dict[str, str]:
    return {f"e{i}{j}": of(i, j) for i in range(3) for j in range(4)}


def translate_cameras(cams: DataFrame, offset: tuple[float, float, float]) -> DataFrame:
    """Extrinsics after the world moved by offset: the translation loses the rotated offset."""
    moved = lambda i: "-".join([f"e{i}3", *[f"e{i}{k}*({o!r})" for k, o in enumerate(offset)]])
    return with_exprs(cams, _cells(lambda i, j: moved(i) if j == 3 else f"e{i}{j}"))


def rotate_cameras(cams: DataFrame, axis: tuple[float, float, float], angle: float) -> DataFrame:
    """Extrinsics after the world turned about an axis through its origin: the turn is undone first."""
    m = geom.axis_rotation(axis, angle)
    return with_exprs(cams, _cells(lambda i, j: f"e{i}3" if j == 3 else "+".join(f"e{i}{k}*({m[j][k]!r})" for k in range(3))))


def scale_cameras(cams: DataFrame, factor: float) -> DataFrame:
    """Extrinsics after the world grew: depths grow, pixels stay."""
    if factor <= 0:
        raise ValueError("a scale is positive")
    return with_exprs(cams, _cells(lambda i, j: f"e{i}3*({factor!r})" if j == 3 else f"e{i}{j}"))
