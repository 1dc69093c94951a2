"""Scenes and transforms by chance: one draw a frame for all parts, refusals, kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuboid.functions import geom, rigid
from cuboid.operators import augment, cameras
from cuboid.operators import transforms as T
from cuboid.operators.boxes import with_exprs
from cuboid.plans.scene import view
from cuboid.transform_queries import MOVES, scene

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    s = scene(spark, SF)
    return s.replace(points=s.points.filter("pt_idx < 20").cache(), boxes=s.boxes.cache(), cameras=s.cameras.cache())


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_pixels_stay_and_depths_grow_with_the_world(small):
    """Points and cameras of a frame are moved alike: what a camera sees does not change but for the scale."""
    after = T.Compose(MOVES)(small)
    see = lambda s: {(r.frame_id, r.pt_idx, r.cam_idx): (r.u, r.v, r.depth) for r in cameras.project(s.points, s.cameras).filter("depth > 1").collect()}
    factor = {r.frame_id: r.f for r in small.points.select("frame_id").distinct().withColumn("f", F.expr(f"CASE WHEN {MOVES[2].goes()} THEN {MOVES[2].params()['f']} ELSE 1.0D END")).collect()}
    before, now = see(small), see(after)
    assert len(before) > 300 and len(set(factor.values())) > 4 and 1.0 in factor.values()
    for k in before.keys() & now.keys():
        u, v, depth = before[k]
        assert now[k] == pytest.approx((u, v, depth * factor[k[0]]), rel=1e-6, abs=1e-6)


def test_points_stay_in_their_boxes_under_a_turn_about_z(spark, small):
    """With a yaw only, a turn about z carries boxes and the points in them alike."""
    flat = small.boxes.withColumns({"pitch": F.lit(0.0), "roll": F.lit(0.0)})
    before = small.replace(boxes=flat, fmt="XYZLWHY")
    after = T.RandomRotate(3.0, (0.0, 0.0, 2.0), 0.7, seed=5)(before)
    at = lambda s: {(r.frame_id, r.box_idx): np.array([r.x, r.y, r.z]) for r in with_exprs(with_exprs(s.boxes, geom.rotation()), dict(zip("xyz", geom.corner(5), strict=True))).collect()}
    plain, moved = at(before), at(after)
    turned = [k for k in plain if not np.allclose(plain[k], moved[k])]
    assert {k[0] for k in turned} and {k[0] for k in plain} - {k[0] for k in turned}  # some frames, not all
    for k in plain:
        assert np.linalg.norm(plain[k]) == pytest.approx(np.linalg.norm(moved[k])) and plain[k][2] == pytest.approx(moved[k][2])


def test_frames_left_alone_do_not_change_at_all(small):
    for t in (T.RandomTranslate((1.0, 1.0, 1.0), 0.0), T.RandomRotate(1.0, (1.0, 1.0, 0.0), 0.0), T.RandomScale(0.5, 2.0, 0.0), T.PointJitter(1.0, 0.0), T.PointShuffle(0.0)):
        out = t(small)
        assert rows(out.points, "frame_id", "pt_idx", "x", "y", "z") == rows(small.points, "frame_id", "pt_idx", "x", "y", "z")
        assert rows(out.boxes, "box_idx", *geom.BOX) == rows(small.boxes, "box_idx", *geom.BOX)
        assert rows(out.cameras, "frame_id", "cam_idx", *rigid.names("e")) == rows(small.cameras, "frame_id", "cam_idx", *rigid.names("e"))


def test_flips_refuse_cameras_whatever_p_is(small):
    flip = T.RandomFlip("y", p=0.0)
    for bad in (small, small.replace(cameras=None, images=True)):
        with pytest.raises(TypeError):
            flip(bad)
        with pytest.raises(TypeError):
            T.Compose([*MOVES, flip])(bad)
    lidar = small.replace(cameras=None)
    out = T.RandomFlip("y", 1.0)(lidar)
    assert rows(out.points.withColumn("y", -F.col("y")), "frame_id", "pt_idx", "y") == rows(lidar.points, "frame_id", "pt_idx", "y")
    share = T.RandomFlip("x", 0.5, seed=8)(lidar).points.join(lidar.points.select("frame_id", "pt_idx", F.col("x").alias("o")), ["frame_id", "pt_idx"]).filter("x <> o").select("frame_id").distinct().count()
    assert 0 < share < lidar.points.select("frame_id").distinct().count()


def test_values_are_checked():
    for make in (lambda: T.RandomFlip("w"), lambda: T.RandomFlip("x", 1.5), lambda: T.RandomTranslate((-1.0, 0, 0)), lambda: T.RandomRotate(1.0, (0, 0, 0)), lambda: T.RandomScale(0.0, 1.0), lambda: T.RandomScale(2.0, 1.0), lambda: T.PointJitter(-1.0), lambda: T.PointSample(0)):
        with pytest.raises(ValueError):
            make()


def test_rotations_refuse_boxes_that_cannot_turn(small):
    with pytest.raises(NotImplementedError):
        T.RandomRotate(1.0)(small.replace(fmt="XYZLWH"))
    with pytest.raises(ValueError):
        T.RandomRotate(1.0, (0.0, 1.0, 1.0))(small.replace(fmt="XYZLWHY"))


def test_kernels_are_registered_once_and_inherited(small):
    class Lift(T.Transform):
        kinds = ("points",)

    with pytest.raises(TypeError):
        Lift()(small)
    T.kernel(Lift, "points")(lambda t, fmt: {"z": "z+1"})
    with pytest.raises(ValueError):
        T.kernel(Lift, "points")(lambda t, fmt: {})
    with pytest.raises(TypeError):
        T.kernel(Lift, "images")

    class Higher(Lift):
        pass

    out = Higher()(small)
    assert out.boxes is small.boxes and out.cameras is small.cameras  # other kinds pass as they are
    assert rows(out.points, "frame_id", "pt_idx", "z") == rows(small.points.withColumn("z", F.col("z") + 1), "frame_id", "pt_idx", "z")


def test_corner_boxes_and_missing_parts(spark):
    boxes = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 2.0, 4.0, 6.0)], "frame_id long, box_idx long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    s = T.Scene(boxes=boxes, fmt="XYZXYZ")
    got = T.Compose([T.RandomFlip("x", 1.0), T.RandomScale(2.0, 2.0), T.RangeFilter((-3, 0, 0), (0, 9, 9))])(s)
    assert got.points is None and [tuple(r)[2:] for r in got.boxes.collect()] == [(-4.0, 0.0, 0.0, 0.0, 8.0, 12.0)]
    assert T.RangeFilter((-2, 0, 0), (0, 1, 9))(got).boxes.count() == 0
    assert T.Compose([])(T.Scene()) == T.Scene()


def test_shuffles_and_samples_agree_in_any_partitioning(spark):
    points = view(spark, SF, "points").limit(3000).selectExpr("frame_id", "row_number() OVER (PARTITION BY frame_id ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pt_idx", "x", "y", "z").cache()
    for t in (T.PointShuffle(seed=2), T.PointShuffle(0.5, seed=2), T.PointSample(40, seed=2)):
        a, b = (rows(t(T.Scene(p)).points, "frame_id", "pt_idx", "x", "y", "z") for p in (points, points.repartition(7)))
        assert a == b
    n = {r.frame_id: r.n for r in T.PointSample(200)(T.Scene(points)).points.groupBy("frame_id").agg(F.count("*").alias("n")).collect()}
    assert set(n.values()) == {200}


def test_samples_of_many_small_frames_are_not_broadcast(spark):
    """Frames with fewer points than slots: every slot holds one of the frame's points, drawn by its hash, and neither the slots
    nor the points go through the driver."""
    df = spark.range(40 * 3 + 9).selectExpr("if(id < 120, id % 40, 99L) AS frame_id", "if(id < 120, id DIV 40, id-120) AS pt_idx", "id/1.0D AS x", "0.0D AS y", "0.0D AS z")
    out = augment.sample_points(df, 7, ["pt_idx"], 4)
    got = {(r.frame_id, r.slot): r.x for r in out.collect()}
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == len(got) == 41 * 7 and {s for _, s in got} == set(range(7))
    assert len({got[99, s] for s in range(7)}) == 7 and all(got[99, s] >= 120 for s in range(7))
    order = {(r.frame_id, r.pt_idx): r.x for r in augment.shuffle_points(df, ["pt_idx"], 4).collect()}
    draw = {(r.frame_id, r.slot): r.k for r in spark.range(40 * 7).selectExpr("id % 40 AS frame_id", "id DIV 40 AS slot").withColumn("k", F.floor(F.expr(geom.uniform(4, "draw", "frame_id", "slot")) * 3)).collect()}
    assert all(got[k] == order[k[0], d] for k, d in draw.items()) and len(set(draw.values())) == 3


def test_shuffled_points_are_worked_out_once(small):
    """Counting a frame's points and its buckets before they are numbered does not repeat the transforms before."""
    steps = [T.PointJitter(0.05, 0.5, 14), *MOVES, T.RangeFilter((-30.0, -30.0, -12.0), (30.0, 35.0, 9.0))]
    plain = T.Compose(steps)(small).points
    out = T.Compose([*steps, T.PointShuffle(0.5, 15)])(small).points
    assert out._jdf.queryExecution().optimizedPlan().toString().count("PointJitter.x1") <= 1
    assert rows(out, "frame_id", "x", "y", "z") == rows(plain, "frame_id", "x", "y", "z")
    assert rows(out, "frame_id", "pt_idx") == [(f, k) for f, n in sorted(plain.groupBy("frame_id").count().collect()) for k in range(n)]
