"""Queries that transform scenes by chance, with SQL that draws the same numbers; orders and samples of points; colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.functions import geom, rigid
from cuboid.operators import augment, cameras, detection, order
from cuboid.operators import transforms as T
from cuboid.paste_queries import POINT_ORDER, numbered_points
from cuboid.plans.registry import query, rounded
from cuboid.plans.registry import rounded_sql as _r
from cuboid.plans.registry import uniform_sql as _u
from cuboid.plans.scene import view

_PTS = f"pts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {', '.join(POINT_ORDER)}) - 1 AS pt_idx FROM points)"


def scene(spark: SparkSession, sf_dir: str) -> T.Scene:
    """The derived scene with six cameras in every frame, each frame's turned and focused a little differently."""
    gt = view(spark, sf_dir, "gt")
    cams = gt.select("frame_id").distinct().withColumn("cam_idx", F.explode(F.sequence(F.lit(0), F.lit(5))))
    cams = cams.withColumns({"cam_yaw": F.expr("2*pi()*cam_idx/6+0.01D*frame_id"), "fx": F.expr("500.0D+frame_id % 7"), "fy": F.expr("500.0D+frame_id % 5"), "skew": F.lit(0.0), "cx0": F.lit(320.0), "cy0": F.lit(240.0), "img_w": F.lit(640), "img_h": F.lit(480)})
    return T.Scene(numbered_points(spark, sf_dir), gt, cameras.extrinsics(cams))


MOVES = [T.RandomTranslate((2.0, 3.0, 0.5), 0.7, 11), T.RandomRotate(0.6, (1.0, 2.0, 3.0), 0.8, 12), T.RandomScale(0.9, 1.1, 0.5, 13)]
_SIZE = 14**0.5
_AXIS = [1 / _SIZE, 2 / _SIZE, 3 / _SIZE]
#: A frame's parameters, drawn in SQL of its own; neutral ones where the frame is left alone.
_DRAWN = f"""pm AS (SELECT frame_id, {', '.join(f"CASE WHEN {_u(11, 'RandomTranslate.p', 'frame_id')} < 0.7 THEN {r}*(2*{_u(11, f'RandomTranslate.{c}', 'frame_id')}-1) ELSE 0 END AS t{c}" for c, r in zip('xyz', (2.0, 3.0, 0.5)))},
CASE WHEN {_u(12, 'RandomRotate.p', 'frame_id')} < 0.8 THEN 0.6*(2*{_u(12, 'RandomRotate.angle', 'frame_id')}-1) ELSE 0 END AS th,
CASE WHEN {_u(13, 'RandomScale.p', 'frame_id')} < 0.5 THEN 0.9+(1.1-0.9)*{_u(13, 'RandomScale.f', 'frame_id')} ELSE 1 END AS f FROM (SELECT DISTINCT frame_id FROM gt))"""


def _rodrigues(v: list[str], back: bool = False) -> list[str]:
    """SQL of a vector turned about the axis by th (or back): v cos + (k x v) sin + k (k . v)(1 - cos)."""
    k, s = _AXIS, "-sin(th)" if back else "sin(th)"
    dot = "(" + "+".join(f"{a!r}*{b}" for a, b in zip(k, v, strict=True)) + ")"
    cross = [f"({k[(i + 1) % 3]!r}*{v[(i + 2) % 3]}-{k[(i + 2) % 3]!r}*{v[(i + 1) % 3]})" for i in range(3)]
    return [f"({v[i]}*cos(th)+{cross[i]}*({s})+{k[i]!r}*{dot}*(1-cos(th)))" for i in range(3)]


def _world(v: list[str]) -> list[str]:
    return [f"{e}*f" for e in _rodrigues([f"({c}+t{a})" for c, a in zip(v, "xyz", strict=True)])]


_X, _Y, _Z = (_rodrigues([f"{float(i == k)}" for i in range(3)]) for k in range(3))
_TURNED = {"yaw": f"yaw+atan2({_X[1]}, {_X[0]})", "pitch": f"pitch-asin(greatest(-1.0, least(1.0, {_X[2]})))", "roll": f"roll+atan2({_Y[2]}, {_Z[2]})"}


@query(f"WITH {_DRAWN} SELECT gt.frame_id, box_idx, {_r(' '.join(geom.BOX), **dict(zip(('cx', 'cy', 'cz'), _world(['cx', 'cy', 'cz']))), **{s: f'{s}*f' for s in 'lwh'}, **_TURNED)} FROM gt JOIN pm ON pm.frame_id = gt.frame_id")
def scene_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of frames that are moved, turned and scaled by chance."""
    return rounded(T.Compose(MOVES)(scene(spark, sf_dir)).boxes.select("frame_id", "box_idx", *geom.BOX))


def _noise(c: str) -> str:
    one, two = (_u(14, f"PointJitter.{c}{k}", "pts.frame_id", "pt_idx") for k in (1, 2))
    return f"{c}+CASE WHEN {_u(14, 'PointJitter.p', 'pts.frame_id')} < 0.5 THEN 0.05*sqrt(-2*ln(1-{one}))*cos(2*pi()*{two}) ELSE 0 END"


@query(f"""WITH {_DRAWN}, {_PTS}, j AS (SELECT pts.frame_id, pt_idx, f0, {', '.join(f'{_noise(c)} AS {c}' for c in 'xyz')} FROM pts),
w AS (SELECT j.frame_id, pt_idx, f0, {', '.join(f'{e} AS {c}' for c, e in zip('xyz', _world(['x', 'y', 'z'])))} FROM j JOIN pm ON pm.frame_id = j.frame_id),
s AS (SELECT *, {_u(15, 'PointShuffle.p', 'frame_id')} < 0.5 AS go, {_u(15, 'shuffle', 'frame_id', 'pt_idx')} AS u FROM w WHERE x >= -30 AND x < 30 AND y >= -30 AND y < 35 AND z >= -12 AND z < 9)
SELECT frame_id, (row_number() OVER (PARTITION BY frame_id ORDER BY CASE WHEN go THEN u END, pt_idx) - 1)::BIGINT AS pt_idx, {_r('x y z f0')} FROM s""")
def scene_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the same frames with noise, cut to a range and shuffled by chance."""
    s = scene(spark, sf_dir)
    s = s.replace(points=s.points.drop("f1"))
    steps = [T.PointJitter(0.05, 0.5, 14), *MOVES, T.RangeFilter((-30.0, -30.0, -12.0), (30.0, 35.0, 9.0)), T.PointShuffle(0.5, 15)]
    return rounded(T.Compose(steps)(s).points.select("frame_id", "pt_idx", "x", "y", "z", F.col("f0").cast("double").alias("f0")))


_AHEAD = [["sin(yaw)", "-cos(yaw)", "0.0"], ["0.0", "0.0", "-1.0"], ["cos(yaw)", "sin(yaw)", "0.0"]]


def _seen(i: int, j: int) -> str:
    """A camera sees a moved world as it saw the world before: rows are turned, offsets are those of the way back, grown."""
    if j < 3:
        return _rodrigues(_AHEAD[i])[j]
    return f"-f*({'+'.join(f'{a}*t{c}' for a, c in zip(_AHEAD[i], 'xyz', strict=True))})"


@query(f"WITH {_DRAWN} SELECT frame_id, cam_idx, {_r(' '.join(rigid.names('e')), **{f'e{i}{j}': _seen(i, j) for i in range(3) for j in range(4)})} FROM (SELECT *, unnest(range(6))::INT AS cam_idx FROM pm), LATERAL (SELECT 2*pi()*cam_idx/6+0.01*frame_id AS yaw)")
def scene_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extrinsics of the same frames' cameras."""
    return rounded(T.Compose(MOVES)(scene(spark, sf_dir)).cameras.select("frame_id", "cam_idx", *rigid.names("e")))


@query(f"WITH {_PTS} SELECT frame_id, (row_number() OVER (PARTITION BY frame_id ORDER BY {_u(3, 'shuffle', 'frame_id', 'pt_idx')}, pt_idx) - 1)::BIGINT AS pt_idx, {_r('x y z')} FROM pts")
def point_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's points in a random order."""
    return rounded(augment.shuffle_points(numbered_points(spark, sf_dir).drop("f0", "f1"), ["pt_idx"], 3).select("frame_id", "pt_idx", "x", "y", "z"))


def _sample_sql(n: int) -> str:
    return f"""WITH {_PTS}, k AS (SELECT frame_id, x, y, z, row_number() OVER (PARTITION BY frame_id ORDER BY {_u(0, 'shuffle', 'frame_id', 'pt_idx')}, pt_idx) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS m FROM pts),
s AS (SELECT frame_id, slot, CASE WHEN m >= {n} THEN slot ELSE floor({_u(0, 'draw', 'frame_id', 'slot')} * m)::BIGINT END AS k FROM (SELECT DISTINCT frame_id, m FROM k), range({n}) r(slot))
SELECT s.frame_id, s.slot::INT AS slot, {_r('x y z')} FROM s JOIN k ON k.frame_id = s.frame_id AND k.k = s.k"""


@query(_sample_sql(64))
def point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 points of every frame."""
    return rounded(augment.sample_points(numbered_points(spark, sf_dir).drop("f0", "f1"), 64, ["pt_idx"]).select("frame_id", "slot", "x", "y", "z"))


@query(_sample_sql(4000))
def point_sample_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4000 points of every frame, drawn with replacement where it has fewer."""
    return rounded(augment.sample_points(numbered_points(spark, sf_dir).drop("f0", "f1"), 4000, ["pt_idx"]).select("frame_id", "slot", "x", "y", "z"))


@query(f"""WITH {_PTS}, d AS (SELECT frame_id, pt_idx, sqrt(x*x+y*y+z*z) AS d FROM pts), q AS (SELECT frame_id, greatest(quantile_cont(d, 0.98), 1e-6) AS far FROM d GROUP BY frame_id),
n AS (SELECT d.frame_id, pt_idx, far, least(d / far, 1.0) AS t FROM d JOIN q ON q.frame_id = d.frame_id)
SELECT frame_id, pt_idx::BIGINT AS pt_idx, round(far, 6) + 0.0 AS far, floor(t * 255)::INT AS red, 0 AS green, floor((1 - t) * 255)::INT AS blue, 255 AS alpha FROM n""")
def viz_point_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points coloured by their distance, from blue to red at the frame's 0.98 quantile."""
    d = numbered_points(spark, sf_dir).select("frame_id", "pt_idx", F.expr("sqrt(x*x+y*y+z*z)").alias("d"))
    far = order.quantile(d, ["frame_id"], "d", 0.98).select("frame_id", F.greatest("d", F.lit(1e-6)).alias("far"))
    t = d.join(far, "frame_id").withColumn("t", F.least(F.col("d") / F.col("far"), F.lit(1.0)))
    channel = lambda e: F.floor(e * 255).cast("int")
    out = t.select("frame_id", "pt_idx", "far", channel(F.col("t")).alias("red"), F.lit(0).alias("green"), channel(1 - F.col("t")).alias("blue"), F.lit(255).alias("alpha"))
    return rounded(out)


_SEEN = """SELECT b.box_idx, c.cam_idx, d > 0 AS visible, d AS depth, CASE WHEN d > 0 THEN fx*(sin(y)*cx-cos(y)*cy)/d+320 ELSE 0 END AS u, CASE WHEN d > 0 THEN fy*(-cz)/d+240 ELSE 0 END AS v
FROM gt b, range(0, 6) c(cam_idx), LATERAL (SELECT 2*pi()*cam_idx/6+0.01*frame_id AS y, 500.0::DOUBLE+frame_id % 7 AS fx, 500.0::DOUBLE+frame_id % 5 AS fy), LATERAL (SELECT cos(y)*cx+sin(y)*cy AS d)"""


@query(f"""WITH s AS ({_SEEN}) SELECT box_idx, cam_idx::INT AS cam_idx, 'h' AS flip, visible, {_r('depth u v', u='CASE WHEN visible THEN 640-u ELSE 0 END')} FROM s
UNION ALL SELECT box_idx, cam_idx::INT, 'v', visible, {_r('depth u v', v='CASE WHEN visible THEN 480-v ELSE 0 END')} FROM s""")
def flip_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box centres of mirrored worlds in the cameras of mirrored images: where they were, mirrored."""
    s, out = scene(spark, sf_dir), None
    for flip, axis in (("h", "y"), ("v", "z")):
        centres = s.boxes.select("frame_id", "box_idx", *[(-F.col(f"c{c}") if c == axis else F.col(f"c{c}")).alias(c) for c in "xyz"])
        seen = cameras.project(centres, cameras.flip_image(s.cameras, flip))
        seen = seen.select("box_idx", "cam_idx", F.lit(flip).alias("flip"), (F.col("depth") > 0).alias("visible"), "depth", *[F.nanvl(c, F.lit(0.0)).alias(c) for c in "uv"])
        out = seen if out is None else out.unionByName(seen)
    return rounded(out)


def _normal(c: str) -> str:
    return f"{c}+0.05*sqrt(-2*ln(1-{_u(6, c + '1', 'frame_id', 'pt_idx')}))*cos(2*pi()*{_u(6, c + '2', 'frame_id', 'pt_idx')})"


@query(f"WITH {_PTS} SELECT frame_id, pt_idx::BIGINT AS pt_idx, {_r('x y z', **{c: _normal(c) for c in 'xyz'})} FROM pts")
def point_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with normal noise."""
    return rounded(augment.jitter_points(numbered_points(spark, sf_dir), 0.05, ["pt_idx"], 6).select("frame_id", "pt_idx", "x", "y", "z"))


@query("""WITH bins(bin, low, high) AS (VALUES (0, 0, 25), (1, 20, 1000)) SELECT label, bin, count(*)::BIGINT AS n FROM gt JOIN bins ON sqrt(cx*cx+cy*cy+cz*cz) >= low AND sqrt(cx*cx+cy*cy+cz*cz) < high GROUP BY ALL""")
def distance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each class by overlapping bins of their distance."""
    return detection.with_bins(view(spark, sf_dir, "gt"), ((0.0, 25.0), (20.0, 1000.0))).groupBy("label", "bin").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT p.frame_id, p.label, p.det_idx, g.box_idx AS gt_idx, sqrt((p.cx-g.cx)*(p.cx-g.cx)+(p.cy-g.cy)*(p.cy-g.cy)) AS far FROM pred p JOIN gt g ON g.frame_id = p.frame_id AND g.label = p.label)
SELECT frame_id, label, det_idx, gt_idx, round(far, 6) + 0.0 AS far FROM j WHERE far < 4""")
def distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and boxes of a class within four metres on the ground."""
    found = detection.candidates_by_distance(view(spark, sf_dir, "pred"), view(spark, sf_dir, "gt"), 4.0)
    return rounded(found.select("frame_id", "label", "det_idx", "gt_idx", F.col("value").alias("far")))
