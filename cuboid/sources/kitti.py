"""Reader of the KITTI object layout: <root>/{training,testing}/{velodyne,calib,image_2,label_2}.

Files are read by Spark (any store), and become one row per point, camera or box, keyed by frame_id (the file's stem).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.operators.cameras import in_view, project

#: Class names in the order of their indices. DontCare rows are dropped, other names get -1.
CLASSES = ("Car", "Pedestrian", "Cyclist", "Van", "Truck", "Person_sitting", "Tram", "Misc")


def _frame(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+)\.[a-z]+$", 1)


def binary_points(spark: SparkSession, path: str, names: tuple[str, ...], glob: str = "*.bin") -> DataFrame:
    """frame_id, pt_idx and names of files of consecutive little-endian 32-bit floats."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, content in zip(batch.column(0), batch.column(1), strict=True):
                values = np.frombuffer(content.as_buffer(), dtype="<f4")
                if len(values) % k:
                    raise ValueError(f"{frame}: {len(values)} numbers are no rows of {k}")
                rows = values.reshape(-1, k)
                for at in range(0, len(rows), 100_000):
                    part = rows[at : at + 100_000]
                    ids = pa.array(np.arange(at, at + len(part), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([frame.as_py()] * len(part), pa.string()), ids, *[pa.array(part[:, i].copy()) for i in range(k)]], names=["frame_id", "pt_idx", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(_frame().alias("frame_id"), "content").mapInArrow(run, "frame_id string, pt_idx long, " + ", ".join(f"{n} float" for n in names))


def frames(spark: SparkSession, root: str, split: str = "training", chosen: Sequence[str] | None = None) -> DataFrame:
    """frame_id of the frames that have points, and calibrated (whether they have a calibration file); with chosen only
    those. Raises ValueError for chosen frames without points."""
    stems = lambda path, glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(_frame().alias("frame_id"))
    calibrated = stems(f"{root}/{split}/calib", "*.txt").withColumn("calibrated", F.lit(True))
    out = stems(f"{root}/{split}/velodyne", "*.bin").join(calibrated, "frame_id", "left").na.fill(False)
    if chosen is None:
        return out
    out = out.filter(F.col("frame_id").isin(*chosen))
    if lost := sorted({*chosen} - {r["frame_id"] for r in out.select("frame_id").collect()}):  # as many rows as chosen
        raise ValueError(f"no points for {lost}")
    return out


def points(spark: SparkSession, root: str, split: str = "training") -> DataFrame:
    return binary_points(spark, f"{root}/{split}/velodyne", ("x", "y", "z", "intensity"))


def _inverse(m: str) -> list[str]:
    """SQL of the 9 entries of a 3x3 matrix's inverse, its entries being columns m00 to m22."""
    e = lambda i, j: f"{m}{i}{j}"
    minor = lambda i, j: f"({e((i + 1) % 3, (j + 1) % 3)}*{e((i + 2) % 3, (j + 2) % 3)}-{e((i + 1) % 3, (j + 2) % 3)}*{e((i + 2) % 3, (j + 1) % 3)})"
    det = "(" + "+".join(f"{e(0, j)}*{minor(0, j)}" for j in range(3)) + ")"
    return [f"{minor(j, i)}/{det}" for i in range(3) for j in range(3)]


def cameras(spark: SparkSession, root: str, split: str = "training") -> DataFrame:
    """frame_id, fx, skew, cx0, fy, cy0 and the extrinsics e00 to e23 (lidar to camera 2: its offset to the
    rectified camera 0, the rectification and the lidar's pose)."""
    lines = spark.read.text(f"{root}/{split}/calib/*.txt").select(_frame("_metadata.file_path").alias("frame_id"), F.split("value", ":").alias("kv"))
    values = F.transform(F.split(F.trim(F.col("kv")[1]), r"\s+"), lambda x: x.cast("double"))
    keys = {"P2": "p", "R0_rect": "r", "Tr_velo_to_cam": "t"}
    rows = lines.filter(F.trim(F.col("kv")[0]).isin(*keys)).groupBy("frame_id").agg(*[F.max(F.when(F.trim(F.col("kv")[0]) == k, values)).alias(v) for k, v in keys.items()])
    p = lambda i, j: f"p[{4 * i + j}]"
    base = {"_z": p(2, 3) + "/" + p(2, 2)}
    rows = rows.withColumn("_z", F.expr(base["_z"]))
    rows = rows.withColumn("_y", F.expr(f"({p(1, 3)}-{p(1, 2)}*_z)/{p(1, 1)}"))
    rows = rows.withColumn("_x", F.expr(f"({p(0, 3)}-{p(0, 1)}*_y-{p(0, 2)}*_z)/{p(0, 0)}"))
    e = {f"e{i}{j}": "+".join(f"r[{3 * i + k}]*t[{4 * k + j}]" for k in range(3)) + (f"+_{'xyz'[i]}" if j == 3 else "") for i in range(3) for j in range(4)}
    k = {"fx": p(0, 0), "skew": p(0, 1), "cx0": p(0, 2), "fy": p(1, 1), "cy0": p(1, 2)}
    return rows.select("frame_id", *[F.expr(v).alias(n) for n, v in {**k, **e}.items()])


def header_size(content: bytes) -> tuple[int, int] | None:
    """Width and height in the header of a PNG or JPEG file; None for other files and cut headers."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 9 <= len(content) and content[at] == 0xFF:
        mark = content[at + 1]
        if mark == 0xFF:  # a filling byte
            at += 1
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:  # marks without a length
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame's header
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def image_sizes(spark: SparkSession, root: str, split: str = "training") -> DataFrame:
    """frame_id, img_w and img_h of the images of camera 2, from their headers; no pixel is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header_size(memoryview(c.as_buffer())[: 1 << 20].tobytes()) for c in batch.column(1)]
            wide, high = (pa.array([None if s is None else s[k] for s in found], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), wide, high], names=["frame_id", "img_w", "img_h"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").option("recursiveFileLookup", "true").load(f"{root}/{split}")
    return files.filter(F.col("path").rlike("/image_2/[^/]+$")).select(_frame().alias("frame_id"), "content").mapInArrow(run, "frame_id string, img_w int, img_h int").filter("img_w IS NOT NULL")


def sized_cameras(spark: SparkSession, root: str, split: str = "training") -> DataFrame:
    """cameras() with img_w and img_h; a frame without a readable image has 1 x 1, so that hardly a point is in view."""
    sizes = image_sizes(spark, root, split)
    return cameras(spark, root, split).join(sizes, "frame_id", "left").na.fill(1, ["img_w", "img_h"])


def points_in_view(spark: SparkSession, root: str, split: str = "training") -> DataFrame:
    """The points that camera 2 sees, in their order."""
    seen = in_view(project(points(spark, root, split), sized_cameras(spark, root, split)))
    return seen.select("frame_id", "pt_idx", "x", "y", "z", "intensity")


def boxes(spark: SparkSession, root: str, split: str = "training", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """frame_id, box_idx, label and boxes in the lidar's frame (yaw is -ry - pi/2, not wrapped)."""
    raw = spark.read.text(f"{root}/{split}/label_2/*.txt").select(_frame("_metadata.file_path").alias("frame_id"), F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("_at"))
    raw = raw.filter((F.size("f") >= 15) & (F.col("f")[0] != "DontCare"))
    order = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    num = [F.col("f")[i].cast("double").alias(n) for i, n in zip(range(8, 15), ("h", "w", "l", "_cx", "_cy", "_cz", "_ry"), strict=True)]
    rows = raw.select("frame_id", "_at", F.coalesce(F.try_element_at(order, F.col("f")[0]), F.lit(-1)).alias("label"), *num)
    rows = rows.withColumn("_cy", F.col("_cy") - F.col("h") / 2).join(cameras(spark, root, split), "frame_id")
    inverse = _inverse("e")
    for i, n in enumerate(("cx", "cy", "cz")):
        rows = rows.withColumn(n, F.expr("+".join(f"({inverse[3 * i + j]})*(_c{'xyz'[j]}-e{j}3)" for j in range(3))))
    from pyspark.sql import Window

    rows = rows.withColumns({"yaw": -F.col("_ry") - F.pi() / 2, "pitch": F.lit(0.0), "roll": F.lit(0.0), "box_idx": F.row_number().over(Window.partitionBy("frame_id").orderBy("_at")) - 1})
    return rows.select("frame_id", "box_idx", "label", "cx", "cy", "cz", "l", "w", "h", "yaw", "pitch", "roll")
