"""The registered queries of the 3D engine and their SQL. All run over whole tables of the derived scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid import chain_queries, paste_queries, transform_queries  # noqa: F401
from cuboid.functions import geom
from cuboid.operators import augment, boxes, cameras, detection, pairs, sweeps, voxels
from cuboid.plans import score_sql
from cuboid.plans.registry import ORACLE_SQL, QUERIES, query, rounded  # noqa: F401
from cuboid.plans.registry import rounded_sql as _r
from cuboid.plans.registry import uniform_sql as _u
from cuboid.plans.scene import view

POINT_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
POINT_ORDER = [*POINT_KEY, "x", "f0", "f1"]


_ROT = ", ".join(f"{v} AS {k}" for k, v in geom.rotation().items())
_BOX = " ".join(geom.BOX)


@query(f"""WITH b AS (SELECT *, {_ROT} FROM gt)
SELECT b.frame_id, b.box_idx, count(p.x)::BIGINT AS n_points FROM b LEFT JOIN points p ON p.frame_id = b.frame_id AND {geom.contains("p.x", "p.y", "p.z")} GROUP BY ALL""")
def points_per_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points every box holds."""
    gt = view(spark, sf_dir, "gt")
    found = pairs.points_in_boxes(view(spark, sf_dir, "points"), gt).groupBy("frame_id", "box_idx").agg(F.count("*").alias("n_points"))
    return gt.select("frame_id", "box_idx").join(found, ["frame_id", "box_idx"], "left").na.fill(0)


@query(f"""WITH b AS (SELECT *, {_ROT} FROM gt), q AS (SELECT p.*, (SELECT min(b.box_idx) FROM b WHERE b.frame_id = p.frame_id AND {geom.contains("p.x", "p.y", "p.z")}) AS i FROM points p)
SELECT frame_id, coalesce(i, -1)::BIGINT AS box_idx, count(*)::BIGINT AS n_points, {_r("sum_x", sum_x="sum(x)")} FROM q GROUP BY ALL""")
def point_box_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by the lowest box that holds them (-1: none)."""
    hit = pairs.lowest_box(view(spark, sf_dir, "points"), view(spark, sf_dir, "gt"), [*POINT_KEY, "x"][:4])
    return rounded(hit.groupBy("frame_id", "box_idx").agg(F.count("*").alias("n_points"), F.sum("x").alias("sum_x")))


@query(f"""WITH b AS (SELECT box_idx, cx-l/2 AS x1, cy-w/2 AS y1, cz-h/2 AS z1, cx+l/2 AS x2, cy+w/2 AS y2, cz+h/2 AS z2 FROM gt)
SELECT box_idx, {_r("x1 y1 z1 x2 y2 z2")}, {_r("cx l", cx="(x1+x2)/2", l="x2-x1")} FROM b""")
def box_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes without angles as corners, and back."""
    low = boxes.convert(view(spark, sf_dir, "gt").select("box_idx", *geom.BOX[:6]), "XYZLWH", "XYZXYZ")
    back = boxes.convert(low, "XYZXYZ", "XYZLWH").select("box_idx", "cx", "l")
    return rounded(low.join(back, "box_idx"))


@query("WITH b AS (SELECT *, " + _ROT + " FROM gt) " + " UNION ALL ".join(f"SELECT box_idx, {k} AS corner, {_r('x y z', **dict(zip('xyz', geom.corner(k), strict=True)))} FROM b" for k in range(8)))
def box_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.corners(view(spark, sf_dir, "gt")).select("box_idx", "corner", "x", "y", "z"))


@query(f"SELECT box_idx, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in geom.rotation().items())} FROM gt")
def box_params_9dof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.params(view(spark, sf_dir, "gt")).select("box_idx", *geom.rotation()))


_FLIPPED = {"x": "cx yaw pitch", "y": "cy yaw roll", "z": "cz pitch roll"}


def _flip_query(axis: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(boxes.flip_boxes(view(spark, sf_dir, "gt"), axis).select("box_idx", *geom.BOX))

    f.__name__ = f"flip_{axis}_boxes"
    query(f"SELECT box_idx, {_r(_BOX, **{c: f'-({c})' for c in _FLIPPED[axis].split()})} FROM gt")(f)


for _axis in "xyz":
    _flip_query(_axis)


@query(f"SELECT frame_id, l_orderkey, l_linenumber, {_r('x y z', x='x+1.5', y='-y-2.0', z='(z+0.25)*1.25')} FROM points")
def move_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points mirrored along y, moved, then z scaled."""
    p = boxes.translate(boxes.flip_points(view(spark, sf_dir, "points"), "y"), (1.5, -2.0, 0.25))
    return rounded(boxes.scale(p, 1.25, ("z",)).select("frame_id", "l_orderkey", "l_linenumber", "x", "y", "z"))


@query(f"""SELECT box_idx, {_r(_BOX, cx='cos(0.5)*cx-sin(0.5)*cy', cy='sin(0.5)*cx+cos(0.5)*cy', yaw='yaw+0.5')} FROM gt""")
def rotate_z_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.rotate_boxes(view(spark, sf_dir, "gt"), (0.0, 0.0, 2.0), 0.5).select("box_idx", *geom.BOX))


@query(f"""SELECT box_idx, {_r(_BOX, cy='cos(0.3)*cy-sin(0.3)*cz', cz='sin(0.3)*cy+cos(0.3)*cz', roll='roll+0.3')} FROM gt""")
def rotate_9dof_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.rotate_boxes(view(spark, sf_dir, "gt"), (1.0, 0.0, 0.0), 0.3).select("box_idx", *geom.BOX))


@query(f"SELECT box_idx, {_r(_BOX, **{c: f'{c}*1.1' for c in geom.BOX[:6]})} FROM gt")
def scale_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.scale(view(spark, sf_dir, "gt"), 1.1, geom.BOX[:6]).select("box_idx", *geom.BOX))


@query("""SELECT frame_id, count(*)::BIGINT AS n, round(sum(x), 4) + 0.0 AS sum_x FROM points
WHERE x >= -10 AND x < 20 AND y >= -15 AND y < 15 AND z >= -0.5 AND z < 0.75 GROUP BY frame_id""")
def range_filter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = boxes.range_filter(view(spark, sf_dir, "points"), (-10, -15, -0.5), (20, 15, 0.75))
    return kept.groupBy("frame_id").agg(F.count("*").alias("n"), (F.round(F.sum("x"), 4) + F.lit(0.0)).alias("sum_x"))


@query("SELECT frame_id, box_idx, label FROM gt WHERE cx >= -10 AND cx < 20 AND cy >= -15 AND cy < 15 AND cz >= -1 AND cz < 1")
def range_filter_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.range_filter(view(spark, sf_dir, "gt"), (-10, -15, -1), (20, 15, 1), ("cx", "cy", "cz")).select("frame_id", "box_idx", "label")


_PROJECTED = """WITH d AS (SELECT b.box_idx, c.cam_idx, cos(cam_yaw)*cx+sin(cam_yaw)*cy AS depth, sin(cam_yaw)*cx-cos(cam_yaw)*cy AS px, -cz AS py, c.* FROM gt b CROSS JOIN cams c)"""


@query(f"""{_PROJECTED} SELECT box_idx, cam_idx, depth > 0 AS visible, {_r('depth u v', u='CASE WHEN depth > 0 THEN fx*px/depth+cx0 ELSE 0 END', v='CASE WHEN depth > 0 THEN fy*py/depth+cy0 ELSE 0 END')} FROM d""")
def project_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box centres in six cameras; pixels are 0 where a centre is behind the camera."""
    b = view(spark, sf_dir, "gt").select("box_idx", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    out = cameras.project(b, cameras.extrinsics(view(spark, sf_dir, "cams")))
    out = out.select("box_idx", "cam_idx", (F.col("depth") > 0).alias("visible"), "depth", F.nanvl("u", F.lit(0.0)).alias("u"), F.nanvl("v", F.lit(0.0)).alias("v"))
    return rounded(out)


@query("""SELECT p.frame_id, c.cam_idx, count(*)::BIGINT AS n FROM points p CROSS JOIN cams c
WHERE cos(cam_yaw)*x+sin(cam_yaw)*y > 0 AND fx*(sin(cam_yaw)*x-cos(cam_yaw)*y)/(cos(cam_yaw)*x+sin(cam_yaw)*y)+cx0 BETWEEN 0 AND 639.9999999
AND fy*(-z)/(cos(cam_yaw)*x+sin(cam_yaw)*y)+cy0 BETWEEN 0 AND 479.9999999 GROUP BY ALL""")
def fov_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the images of six cameras; a point within 1e-7 pixels of the right or lower border is outside."""
    seen = cameras.in_view(cameras.project(view(spark, sf_dir, "points"), cameras.extrinsics(view(spark, sf_dir, "cams"))), 1e-7)
    return seen.groupBy("frame_id", "cam_idx").agg(F.count("*").alias("n"))


@query(f"""SELECT cam_idx, 'resize' AS op, {_r('fx fy cx0 cy0', fx='fx*0.5', cx0='cx0*0.5')}, 320 AS img_w, 480 AS img_h FROM cams
UNION ALL SELECT cam_idx, 'crop', fx, fy, cx0-10, cy0-20, 300, 200 FROM cams UNION ALL SELECT cam_idx, 'center_crop', fx, fy, cx0-170, cy0-140, 300, 200 FROM cams
UNION ALL SELECT cam_idx, 'pad', fx, fy, cx0+4, cy0+6, 648, 492 FROM cams UNION ALL SELECT cam_idx, 'resized_crop', fx*2, fy*2, (cx0-10)*2, (cy0-20)*2, 600, 400 FROM cams
UNION ALL SELECT cam_idx, 'hflip', fx, fy, 640-cx0, cy0, 640, 480 FROM cams UNION ALL SELECT cam_idx, 'vflip', fx, fy, cx0, 480-cy0, 640, 480 FROM cams""")
def intrinsics_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intrinsics under resize, crop, center crop, pad, resized crop and flips."""
    c = view(spark, sf_dir, "cams")
    done = {
        "resize": cameras.resize(c, 320, 480), "crop": cameras.crop(c, 20, 10, 200, 300), "center_crop": cameras.center_crop(c, 200, 300), "pad": cameras.pad(c, (4, 6)),
        "resized_crop": cameras.resized_crop(c, 20, 10, 200, 300, 600, 400), "hflip": cameras.flip_image(c, "h"), "vflip": cameras.flip_image(c, "v"),
    }
    out = None
    for name, df in done.items():
        df = df.select("cam_idx", F.lit(name).alias("op"), *[F.col(x).cast("double").alias(x) for x in ("fx", "fy", "cx0", "cy0")], F.col("img_w").cast("int").alias("img_w"), F.col("img_h").cast("int").alias("img_h"))
        out = df if out is None else out.unionByName(df)
    return rounded(out)


_SIDES = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in [*geom.BOX, *geom.rotation()])


@query(f"""WITH r AS (SELECT *, {_ROT} FROM gt), j AS (SELECT a.frame_id, a.box_idx AS a_box, b.box_idx AS b_box, {_SIDES} FROM r a JOIN r b ON a.frame_id = b.frame_id AND a.box_idx < b.box_idx)
SELECT frame_id, a_box, b_box FROM j WHERE {' AND '.join(geom.separated())}""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = view(spark, sf_dir, "gt")
    return pairs.overlapping(gt, gt).filter("a_box_idx < b_box_idx").select("frame_id", F.col("a_box_idx").alias("a_box"), F.col("b_box_idx").alias("b_box"))


_PAIRED = "j AS (SELECT a.frame_id, a.label, a.det_idx, b.box_idx, " + ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in geom.BOX[:6]) + ", a.score FROM pred a JOIN gt b ON a.frame_id = b.frame_id)"


@query(f"""WITH {_PAIRED} SELECT frame_id, det_idx, box_idx, round({geom.aligned_iou()}, 6) + 0.0 AS iou FROM j WHERE {geom.aligned_iou()} > 0""")
def iou_axis_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.aligned_iou(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt"))
    return rounded(found.select("frame_id", F.col("a_det_idx").alias("det_idx"), F.col("b_box_idx").alias("box_idx"), "iou"))


@query()
def iou_9dof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and IoU of oriented boxes (no SQL: polygons are clipped; tests compare with sampling)."""
    found = pairs.oriented_iou(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt"))
    return rounded(found.select("frame_id", F.col("a_det_idx").alias("det_idx"), F.col("b_box_idx").alias("box_idx"), "volume", "iou"))


_NMS = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY score DESC, det_idx) AS k FROM pred),
s AS (SELECT {g}, det_idx, k, label AS lab, {cols} FROM n),
e AS (SELECT b.det_idx AS worse, list(a.det_idx) AS better FROM n x JOIN n y ON {on} AND x.k < y.k
  JOIN (SELECT det_idx, {a} FROM n) a ON a.det_idx = x.det_idx JOIN (SELECT det_idx, {b} FROM n) b ON b.det_idx = y.det_idx WHERE {iou} > 0.1 GROUP BY b.det_idx),
r AS (SELECT DISTINCT {g}, 0::BIGINT AS k, []::BIGINT[] AS kept FROM n UNION ALL
  SELECT {rg}, r.k + 1, CASE WHEN e.better IS NOT NULL AND list_has_any(e.better, r.kept) THEN r.kept ELSE list_append(r.kept, n.det_idx) END
  FROM r JOIN n ON {ron} AND n.k = r.k + 1 LEFT JOIN e ON e.worse = n.det_idx),
f AS (SELECT {g}, unnest(arg_max(kept, k)) AS det_idx FROM r GROUP BY {g})
SELECT pred.frame_id, pred.det_idx, pred.label FROM f JOIN pred ON pred.det_idx = f.det_idx"""


def _nms_sql(group: list[str]) -> str:
    same = " AND ".join
    return _NMS.format(
        g=", ".join(group), rg=", ".join(f"r.{c}" for c in group), ron=same([f"r.{c} = n.{c}" for c in group]), on=same([f"x.{c} = y.{c}" for c in group]),
        cols=", ".join(geom.BOX[:6]), a=", ".join(f"{c} AS a_{c}" for c in geom.BOX[:6]), b=", ".join(f"{c} AS b_{c}" for c in geom.BOX[:6]), iou=geom.aligned_iou())


@query(_nms_sql(["frame_id"]))
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression at IoU 0.1 of axis-aligned boxes."""
    return detection.nms(view(spark, sf_dir, "pred"), 0.1, fmt="XYZLWH").select("frame_id", "det_idx", "label")


@query(_nms_sql(["frame_id", "label"]))
def batched_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression at IoU 0.1 of axis-aligned boxes, each class apart."""
    return detection.nms(view(spark, sf_dir, "pred"), 0.1, True, "XYZLWH").select("frame_id", "det_idx", "label")


def _yaw_levels(source: str) -> str:
    """SQL of geom.yaw_iou over the pairs of a table, a level of SELECT a step."""
    for step in geom.yaw_iou():
        source = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM {source})"
    return source


_YAW_PAIR = lambda one, two: ", ".join(f"{t}.{c} AS {s}_{c}" for s, t in (("a", one), ("b", two)) for c in geom.BOX[:7])


@query(f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_idx) AS k FROM pred),
j AS (SELECT x.det_idx AS better, y.det_idx AS worse, {_YAW_PAIR("x", "y")} FROM n x JOIN n y ON x.frame_id = y.frame_id AND x.k < y.k),
e AS (SELECT worse, list(better) AS better FROM {_yaw_levels("j")} WHERE iou > 0.1 GROUP BY worse),
r AS (SELECT DISTINCT frame_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM n UNION ALL
  SELECT r.frame_id, r.k + 1, CASE WHEN e.better IS NOT NULL AND list_has_any(e.better, r.kept) THEN r.kept ELSE list_append(r.kept, n.det_idx) END FROM r JOIN n ON r.frame_id = n.frame_id AND n.k = r.k + 1 LEFT JOIN e ON e.worse = n.det_idx),
f AS (SELECT frame_id, unnest(arg_max(kept, k)) AS det_idx FROM r GROUP BY frame_id) SELECT pred.frame_id, pred.det_idx, pred.label FROM f JOIN pred ON pred.det_idx = f.det_idx""")
def nms_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression of boxes with a yaw at IoU 0.1."""
    return detection.nms(view(spark, sf_dir, "pred"), 0.1, fmt="XYZLWHY").select("frame_id", "det_idx", "label")


@query()
def batched_nms_9dof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression of oriented boxes, each class apart (no SQL for oriented IoU; tests compare with a plain loop)."""
    return detection.nms(view(spark, sf_dir, "pred"), 0.1, True).select("frame_id", "det_idx", "label")


@query(f"""WITH j AS (SELECT a.frame_id, a.det_idx, b.box_idx, {_YAW_PAIR("a", "b")} FROM pred a JOIN gt b ON a.frame_id = b.frame_id) SELECT frame_id, det_idx, box_idx, round(iou, 6) + 0.0 AS iou FROM {_yaw_levels("j")} WHERE iou > 0""")
def iou_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of boxes with a yaw."""
    found = pairs.iou(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt"), fmt="XYZLWHY")
    return rounded(found.select("frame_id", F.col("a_det_idx").alias("det_idx"), F.col("b_box_idx").alias("box_idx"), "iou"))


@query()
def match_iou_9dof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matches of detections to oriented boxes at IoU 0.1."""
    return detection.match(detection.candidates_by_iou(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt"), 0.1))


@query("SELECT frame_id, det_idx, label FROM pred WHERE score >= 0.5")
def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.score_filter(view(spark, sf_dir, "pred"), 0.5).select("frame_id", "det_idx", "label")


@query("SELECT frame_id, det_idx, label FROM pred WHERE label IN (0, 1, 2)")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.class_filter(view(spark, sf_dir, "pred"), (0, 1, 2)).select("frame_id", "det_idx", "label")


@query(f"""WITH b AS (SELECT *, {_ROT} FROM gt)
SELECT b.frame_id, b.box_idx FROM b JOIN points p ON p.frame_id = b.frame_id AND {geom.contains("p.x", "p.y", "p.z")} GROUP BY ALL HAVING count(*) >= 3""")
def min_points_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that hold at least three points."""
    return pairs.min_points(view(spark, sf_dir, "gt"), view(spark, sf_dir, "points"), 3).select("frame_id", "box_idx")


@query(f"""WITH c AS (SELECT box_idx, {', '.join(f'{v} AS {k}' for k, v in geom.convert('XYZLWH', 'XYZXYZ').items())} FROM gt)
SELECT box_idx, {_r('x1 y1 z1 x2 y2 z2', x1='-x2+1', x2='-x1+1', y1='y1+2', y2='y2+2', z1='z1+3', z2='z2+3')} FROM c""")
def move_corner_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of corners, mirrored along x and moved by (1, 2, 3)."""
    c = boxes.convert(view(spark, sf_dir, "gt"), "XYZLWH", "XYZXYZ").select("box_idx", *geom.columns("XYZXYZ"))
    return rounded(boxes.translate_boxes(boxes.flip_boxes(c, "x", "XYZXYZ"), (1.0, 2.0, 3.0), "XYZXYZ"))


@query(f"SELECT box_idx, {_r('cx cy cz l w h yaw', cz='-cz')} FROM gt")
def flip_z_yaw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a yaw only keep it when mirrored along z."""
    return rounded(boxes.flip_boxes(view(spark, sf_dir, "gt"), "z", "XYZLWHY").select("box_idx", *geom.columns("XYZLWHY")))


@query(f"""SELECT box_idx, cam_idx, {_r('depth', depth='2*(cos(cam_yaw)*cx+sin(cam_yaw)*cy)')} FROM gt CROSS JOIN cams""")
def move_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of box centres in cameras after points and extrinsics were turned, moved and doubled alike."""
    c, b = cameras.extrinsics(view(spark, sf_dir, "cams")), view(spark, sf_dir, "gt").select("box_idx", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    axis, angle, offset = (1.0, 2.0, 3.0), 0.7, (4.0, -5.0, 6.0)
    c = cameras.scale_cameras(cameras.translate_cameras(cameras.rotate_cameras(c, axis, angle), offset), 2.0)
    b = boxes.scale(boxes.translate(boxes.rotate_points(b, axis, angle), offset), 2.0, ("x", "y", "z"))
    return rounded(cameras.project(b, c).select("box_idx", "cam_idx", "depth"))


_LOW, _HIGH, _SIZE = (-40.0, -40.0, -1.0), (40.0, 40.0, 1.0), (4.0, 4.0, 1.0)
_CELLS = """c AS (SELECT *, least(CAST(trunc(CAST((x::FLOAT - (-40.0)::FLOAT) / 4.0::FLOAT AS FLOAT)) AS INT), 19) AS ix, least(CAST(trunc(CAST((y::FLOAT - (-40.0)::FLOAT) / 4.0::FLOAT AS FLOAT)) AS INT), 19) AS iy,
least(CAST(trunc(CAST((z::FLOAT - (-1.0)::FLOAT) / 1.0::FLOAT AS FLOAT)) AS INT), 1) AS iz FROM points WHERE x >= -40 AND x::FLOAT < 40 AND y >= -40 AND y::FLOAT < 40 AND z >= -1 AND z::FLOAT < 1)"""


@query(f"WITH {_CELLS} SELECT frame_id, ix, iy, iz, count(*)::BIGINT AS n FROM c GROUP BY ALL")
def voxelize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = voxels.with_cells(view(spark, sf_dir, "points"), _LOW, _HIGH, _SIZE)
    return cells.groupBy("frame_id", "ix", "iy", "iz").agg(F.count("*").alias("n"))


@query(f"""WITH {_CELLS}, s AS (SELECT *, (iz * 20 + iy) * 20 + ix AS cell, row_number() OVER (PARTITION BY frame_id, (iz * 20 + iy) * 20 + ix ORDER BY {', '.join(POINT_ORDER)}) AS k FROM c),
t AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY cell) AS v FROM s)
SELECT frame_id, cell::BIGINT AS cell, least(count(*), 4)::BIGINT AS num_points, round(sum(CASE WHEN k <= 4 THEN x END), 6) + 0.0 AS sum_x FROM t WHERE v <= 200 GROUP BY frame_id, cell""")
def voxelize_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with at most 4 points each, and the lowest 200 cells of a frame."""
    out = voxels.voxelize(view(spark, sf_dir, "points"), _LOW, _HIGH, _SIZE, POINT_ORDER, 4, 200)
    return rounded(out.groupBy("frame_id", "cell").agg(F.max("num_points").alias("num_points"), F.sum("x").alias("sum_x")))


_MATCH = f"""WITH RECURSIVE {_PAIRED}, o AS (SELECT j.*, {geom.aligned_iou()} AS iou FROM j JOIN gt ON gt.box_idx = j.box_idx AND gt.label = j.label),
p AS (SELECT frame_id, label, det_idx, score, list(box_idx ORDER BY iou DESC, box_idx) AS want FROM o WHERE iou >= 0.1 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, label ORDER BY score DESC, det_idx) AS k FROM p),
r AS (SELECT DISTINCT frame_id, label, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS det_idx, NULL::BIGINT AS gt_idx FROM k UNION ALL
  SELECT r.frame_id, r.label, r.k + 1, CASE WHEN x.g IS NULL THEN r.taken ELSE list_append(r.taken, x.g) END, k.det_idx, x.g
  FROM r JOIN k ON r.frame_id = k.frame_id AND r.label = k.label AND k.k = r.k + 1, LATERAL (SELECT list_filter(k.want, lambda q: NOT list_contains(r.taken, q))[1] AS g) x)
SELECT det_idx, gt_idx FROM r WHERE gt_idx IS NOT NULL"""


@query(_MATCH)
def match_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matches of detections to boxes at IoU 0.1 (boxes without their angles)."""
    return detection.match(detection.candidates_by_iou(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt"), 0.1, "XYZLWH"))


_CURVE = _MATCH.replace("SELECT det_idx, gt_idx FROM r WHERE gt_idx IS NOT NULL", """, m AS (SELECT det_idx FROM r WHERE gt_idx IS NOT NULL),
c AS (SELECT label, sum((det_idx IN (SELECT det_idx FROM m))::INT) OVER w AS tp, row_number() OVER w AS seen FROM pred WINDOW w AS (PARTITION BY label ORDER BY score DESC, det_idx)),
n AS (SELECT label, count(*) AS num_gt FROM gt GROUP BY label)""")


@query(_CURVE + """, t AS (SELECT n.label, n.num_gt, k, coalesce(max(tp / seen) FILTER (tp * 40 >= k * num_gt), 0) AS p FROM n CROSS JOIN range(1, 41) q(k) LEFT JOIN c ON c.label = n.label GROUP BY ALL)
SELECT label, num_gt::BIGINT AS num_gt, round(avg(p), 6) + 0.0 AS ap FROM t GROUP BY ALL""")
def ap_r40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ap(spark, sf_dir, "r40")


@query(_CURVE + """, t AS (SELECT n.label, n.num_gt, k, coalesce(max(tp / seen) FILTER (tp * 10 >= k * num_gt), 0) AS p FROM n CROSS JOIN range(0, 11) q(k) LEFT JOIN c ON c.label = n.label GROUP BY ALL)
SELECT label, num_gt::BIGINT AS num_gt, round(avg(p), 6) + 0.0 AS ap FROM t GROUP BY ALL""")
def ap_r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ap(spark, sf_dir, "r11")


@query(_CURVE + """, d AS (SELECT c.label, tp, max(tp / seen) AS p FROM c WHERE tp > 0 GROUP BY ALL), v AS (SELECT label, max(p) OVER (PARTITION BY label ORDER BY tp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM d)
SELECT n.label, n.num_gt::BIGINT AS num_gt, round(coalesce(sum(v.p), 0) / n.num_gt, 6) + 0.0 AS ap FROM n LEFT JOIN v ON v.label = n.label GROUP BY n.label, n.num_gt""")
def ap_all_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ap(spark, sf_dir, "all_points")


@query(_CURVE + """, t AS (SELECT n.label, n.num_gt, k, coalesce(max(tp / seen) FILTER (tp * 100 >= k * num_gt OR (tp / num_gt)::FLOAT >= (k::FLOAT / 100)), 0) AS p FROM n CROSS JOIN range(0, 101) q(k) LEFT JOIN c ON c.label = n.label GROUP BY ALL)
SELECT label, num_gt::BIGINT AS num_gt, round(avg(p), 6) + 0.0 AS ap FROM t GROUP BY ALL""")
def ap_r101(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ap(spark, sf_dir, "r101")


def _ap(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    pred, gt = view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt")
    hits = match_iou(spark, sf_dir).select("det_idx", F.lit(True).alias("hit"))
    flagged = pred.select("label", "score", "det_idx").join(hits, "det_idx", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    totals = gt.groupBy("label").agg(F.count("*").alias("num_gt"))
    ap = detection.average_precision(detection.running(flagged, ["label"], "score", "det_idx", "hit"), totals, ["label"], how)
    return rounded(ap.select("label", "num_gt", "ap"))


@query()
def map3d_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP of oriented boxes by class, IoU and distance bin, with roll-ups."""
    out = detection.map3d(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt"), (0.1, 0.3), ((0.0, 25.0), (25.0, 1000.0)))
    return rounded(out)


_FAR = "sqrt(cx*cx+cy*cy+cz*cz)"
#: The same with axis-aligned boxes, a loop over the detections of every frame, class, bin and IoU.
_BINNED = f"""WITH RECURSIVE bins(bin, low, high) AS (VALUES (0, 0, 25), (1, 20, 1000)), ious(iou) AS (VALUES (0.1::DOUBLE), (0.3::DOUBLE)),
p AS (SELECT pred.*, bin FROM pred JOIN bins ON {_FAR} >= low AND {_FAR} < high), g AS (SELECT gt.*, bin FROM gt JOIN bins ON {_FAR} >= low AND {_FAR} < high),
j AS (SELECT a.frame_id, a.label, a.bin, a.det_idx, b.box_idx, a.score, {", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in geom.BOX[:6])} FROM p a JOIN g b ON a.frame_id = b.frame_id AND a.label = b.label AND a.bin = b.bin),
o AS (SELECT j.*, {geom.aligned_iou()} AS v FROM j), w AS (SELECT frame_id, label, bin, iou, det_idx, score, list(box_idx ORDER BY v DESC, box_idx) AS want FROM o JOIN ious ON v >= iou GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, label, bin, iou ORDER BY score DESC, det_idx) AS k FROM w),
r AS (SELECT DISTINCT frame_id, label, bin, iou, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS det_idx, NULL::BIGINT AS gt_idx FROM k UNION ALL
  SELECT r.frame_id, r.label, r.bin, r.iou, r.k + 1, CASE WHEN x.g IS NULL THEN r.taken ELSE list_append(r.taken, x.g) END, k.det_idx, x.g
  FROM r JOIN k ON r.frame_id = k.frame_id AND r.label = k.label AND r.bin = k.bin AND r.iou = k.iou AND k.k = r.k + 1, LATERAL (SELECT list_filter(k.want, lambda q: NOT list_contains(r.taken, q))[1] AS g) x),
m AS (SELECT DISTINCT bin, iou, det_idx FROM r WHERE gt_idx IS NOT NULL),
c AS (SELECT p.label, p.bin, i.iou, sum((m.det_idx IS NOT NULL)::INT) OVER w AS tp, row_number() OVER w AS seen FROM p CROSS JOIN ious i LEFT JOIN m ON m.bin = p.bin AND m.iou = i.iou AND m.det_idx = p.det_idx WINDOW w AS (PARTITION BY p.label, p.bin, i.iou ORDER BY score DESC, p.det_idx)),
n AS (SELECT s.label, s.bin, i.iou, coalesce(x.n, 0) AS num_gt FROM (SELECT label, bin FROM p UNION SELECT label, bin FROM g) s CROSS JOIN ious i LEFT JOIN (SELECT label, bin, count(*) AS n FROM g GROUP BY ALL) x ON x.label = s.label AND x.bin = s.bin),
t AS (SELECT n.label, n.bin, n.iou, n.num_gt, k, coalesce(max(tp / seen) FILTER (tp * 40 >= k * num_gt), 0) AS p FROM n CROSS JOIN range(1, 41) q(k) LEFT JOIN c ON c.label = n.label AND c.bin = n.bin AND c.iou = n.iou GROUP BY ALL),
u AS (SELECT label, bin, iou, num_gt, CASE WHEN num_gt > 0 THEN avg(p) END AS ap FROM t GROUP BY label, bin, iou, num_gt)
SELECT label, iou, bin, num_gt::BIGINT AS num_gt, round(coalesce(ap, -1), 6) + 0.0 AS ap, (4*(label IS NULL)::INT + 2*(iou IS NULL)::INT + (bin IS NULL)::INT)::BIGINT AS level
FROM (SELECT label, iou, bin, sum(num_gt) AS num_gt, avg(ap) AS ap FROM u GROUP BY GROUPING SETS ((), (label), (iou), (label, iou), (bin), (label, bin), (label, iou, bin)))"""


@query(_BINNED)
def map3d_range_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP of axis-aligned boxes by class, IoU and overlapping distance bins, with roll-ups."""
    return rounded(detection.map3d(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt"), (0.1, 0.3), ((0.0, 25.0), (20.0, 1000.0)), fmt="XYZLWH"))


_DISTANCES = (0.5, 1.0, 2.0, 4.0)


@query(f"{score_sql.matched(_DISTANCES)}, {score_sql.AP} SELECT label, threshold, round(ap, 6) + 0.0 AS ap FROM aps")
def nds_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP of distance matching at 0.5, 1, 2 and 4 metres."""
    return rounded(detection.nds_ap(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt")))


@query(f"{score_sql.matched((2.0,))}, {score_sql.errors(2.0)} SELECT label, metric, round(error, 6) + 0.0 AS error FROM errs")
def nds_tp_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean errors of the true positives of each class at 2 metres."""
    return rounded(detection.tp_errors(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt")))


@query(score_sql.score(_DISTANCES, 2.0, 5.0))
def nds_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite detection score."""
    return rounded(detection.detection_score(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt")))


@query(score_sql.score((1.0, 2.0), 2.0, 3.0, ("trans", "orient", "vel"), (0, 1, 2, 3, 4, 77), (1,), ((2, "vel"), (3, "orient"))))
def nds_score_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of six classes, one of them without any box, three errors, half turns and skips."""
    how = detection.Scoring((0, 1, 2, 3, 4, 77), (1.0, 2.0), 2.0, weight=3.0, metrics=("trans", "orient", "vel"), half_turn=(1,), skips=((2, "vel"), (3, "orient")))
    return rounded(detection.detection_score(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt"), how))


@query(f"""SELECT box_idx, {_r('cx cy cz yaw', cx=f"CASE WHEN {_u(1, 'flipx', 'frame_id')} < 0.5 THEN -cx ELSE cx END", yaw=f"CASE WHEN {_u(1, 'flipx', 'frame_id')} < 0.5 THEN -yaw ELSE yaw END")} FROM gt""")
def random_flip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(augment.random_flip(view(spark, sf_dir, "gt"), "x", 0.5, geom.flip("x"), 1).select("box_idx", "cx", "cy", "cz", "yaw"))


@query(f"""SELECT box_idx, {_r('cx cy cz l', cx=f"(cx+2.0*(2*{_u(2, 'move0', 'frame_id')}-1))*(0.9+0.2*{_u(2, 'scale', 'frame_id')})", cy=f"(cy+2.0*(2*{_u(2, 'move1', 'frame_id')}-1))*(0.9+0.2*{_u(2, 'scale', 'frame_id')})",
cz=f"(cz+0.5*(2*{_u(2, 'move2', 'frame_id')}-1))*(0.9+0.2*{_u(2, 'scale', 'frame_id')})", l=f"l*(0.9+0.2*{_u(2, 'scale', 'frame_id')})")} FROM gt""")
def random_translate_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = augment.random_translate(view(spark, sf_dir, "gt"), (2.0, 2.0, 0.5), ("cx", "cy", "cz"), 2)
    return rounded(augment.random_scale(moved, 0.9, 1.1, geom.BOX[:6], 2).select("box_idx", "cx", "cy", "cz", "l"))


@query("""WITH t(label, target) AS (VALUES (0, 4), (1, 3), (2, 6)), f AS (SELECT DISTINCT frame_id FROM gt), h AS (SELECT frame_id, label, count(*) AS n FROM gt GROUP BY ALL)
SELECT f.frame_id, t.label, greatest(t.target - coalesce(h.n, 0), 0)::BIGINT AS missing FROM f CROSS JOIN t LEFT JOIN h ON h.frame_id = f.frame_id AND h.label = t.label""")
def copy_paste_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.deficit(view(spark, sf_dir, "gt"), paste_queries.TARGETS)


@query("""SELECT box_idx, label, round(0.6*sqrt(w*h), 6) + 0.0 AS arrow, round(cx+cos(yaw)*cos(pitch)*l/2, 6) + 0.0 AS ax, round(cy+sin(yaw)*cos(pitch)*l/2, 6) + 0.0 AS ay,
round(cz-sin(pitch)*l/2, 6) + 0.0 AS az, printf('class %d %.2f', label, 0.5) AS caption FROM gt""")
def viz_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading arrows (from the front face) and captions of boxes."""
    b = boxes.params(view(spark, sf_dir, "gt"))
    arrow = {"arrow": "0.6D*sqrt(w*h)", "ax": "cx+r00*l/2", "ay": "cy+r10*l/2", "az": "cz+r20*l/2", "caption": "format_string('class %d %.2f', label, 0.5D)"}
    return rounded(boxes.with_exprs(b, arrow).select("box_idx", "label", *arrow))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts, event_id) AS i FROM sweeps)
SELECT a.sensor, a.event_id AS frame, b.event_id AS sweep, (a.i - b.i)::INT AS back FROM k a JOIN k b ON a.sensor = b.sensor AND b.i <= a.i AND a.i - b.i < 3""")
def sweeps_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's three latest sweeps of its sensor."""
    s = view(spark, sf_dir, "sweeps").withColumn("seq", F.struct("ts", "event_id"))
    out = sweeps.last_sweeps(s.select("sensor", "seq"), s.select("sensor", "seq"), 3, F.to_date("seq.ts"))
    return out.select("sensor", F.col("frame.event_id").alias("frame"), F.col("sweep.event_id").alias("sweep"), "back")


@query(f"""SELECT event_id, {_r('x y z dt', x='cos(0.1*(sensor % 7))*x-sin(0.1*(sensor % 7))*y+1.0', y='sin(0.1*(sensor % 7))*x+cos(0.1*(sensor % 7))*y', z='z-0.5', dt='(sensor % 7)/20.0')} FROM sweeps""")
def sweeps_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep points carried into a common frame by each sensor's pose."""
    p = view(spark, sf_dir, "sweeps").withColumn("sweep", F.col("sensor"))
    a = "0.1D*(sweep % 7)"
    t = {"t00": f"cos({a})", "t01": f"-sin({a})", "t02": "0.0D", "t03": "1.0D", "t10": f"sin({a})", "t11": f"cos({a})", "t12": "0.0D", "t13": "0.0D", "t20": "0.0D", "t21": "0.0D", "t22": "1.0D", "t23": "-0.5D"}
    poses = boxes.with_exprs(p.select("sweep").distinct(), t | {"dt": "(sweep % 7)/20.0D"})
    return rounded(sweeps.accumulate(p, poses).select("event_id", "x", "y", "z", "dt"))


@query("SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100")
def stream_object_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 newest events of each type, gathered by a stream into a table."""
    import uuid

    from cuboid.plans.tables import shared_folder
    from cuboid.streaming.updates import Log, newest

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = Log(spark, f"{folder}/rows")
    log.follow(stream.select("event_type", "event_id", "user_id", "ts"), f"{folder}/checkpoint", lambda b: newest(b, ["event_type"], ["ts", "event_id"], 100)).awaitTermination()
    return newest(log.rows(), ["event_type"], ["ts", "event_id"], 100).select("event_type", "event_id", "user_id")


_BUCKETS = 1 << 20
_STATE = _MATCH.replace("SELECT det_idx, gt_idx FROM r WHERE gt_idx IS NOT NULL", f""", m AS (SELECT det_idx FROM r WHERE gt_idx IS NOT NULL),
q AS (SELECT label, least(greatest(floor(score * {_BUCKETS}), 0), {_BUCKETS - 1}) AS bucket, count(*) AS n, sum((det_idx IN (SELECT det_idx FROM m))::INT) AS hits FROM pred GROUP BY ALL),
c AS (SELECT label, sum(hits) OVER w AS tp, sum(n) OVER w AS seen FROM q WINDOW w AS (PARTITION BY label ORDER BY bucket DESC)), n AS (SELECT label, count(*) AS num_gt FROM gt GROUP BY label),
t AS (SELECT n.label, n.num_gt, k, coalesce(max(tp / seen) FILTER (tp * 40 >= k * num_gt), 0) AS p FROM n CROSS JOIN range(1, 41) s(k) LEFT JOIN c ON c.label = n.label GROUP BY ALL)
SELECT label::BIGINT AS label, num_gt::BIGINT AS num_gt, round(avg(p), 6) + 0.0 AS ap FROM t GROUP BY ALL""")


def frame_files(spark: SparkSession, sf_dir: str, folder: str, files: int) -> None:
    """Writes the scene's detections and boxes to folder, so many files of whole frames."""
    pred, gt = view(spark, sf_dir, "pred").withColumnRenamed("det_idx", "idx"), view(spark, sf_dir, "gt").withColumnRenamed("box_idx", "idx")
    names = ["frame_id", "idx", F.col("label").cast("long").alias("label"), *geom.BOX]
    rows = pred.select(F.lit("pred").alias("kind"), "score", *names).unionByName(gt.select(F.lit("gt").alias("kind"), F.lit(None).cast("double").alias("score"), *names))
    rows.repartitionByRange(files, "frame_id").write.parquet(folder)


@query(_STATE)
def stream_metric_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP of each class after a stream of frames has come by in several micro-batches."""
    import uuid

    from cuboid.plans.tables import shared_folder
    from cuboid.streaming.metrics import StreamedPrecision

    folder = f"{shared_folder(spark)}/metric-{uuid.uuid4().hex}"
    frame_files(spark, sf_dir, f"{folder}/frames", 3)
    metric = StreamedPrecision(spark, folder, (0.1,), _BUCKETS, "XYZLWH")
    metric.update(spark.readStream.schema(spark.read.parquet(f"{folder}/frames").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/frames"))
    return rounded(metric.compute().select("label", "num_gt", "ap"))
