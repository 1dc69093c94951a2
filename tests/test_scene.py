"""The scene engine against hand-computed values, loops in plain Python and DuckDB."""

import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuboid.functions import geom
from cuboid.operators import augment, boxes, cameras, detection, greedy, pairs, voxels
from cuboid.plans.scene import view
from cuboid.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
BOX = "frame_id long, box_idx long, label long, cx double, cy double, cz double, l double, w double, h double, yaw double, pitch double, roll double"
#: Queries with SQL that are cheap enough to compare here; the driver compares all.
COMPARED = ["points_per_box", "point_box_index", "box_corners", "overlap_pairs", "nms", "match_iou", "ap_r40", "voxelize_capped", "random_flip_boxes", "intrinsics_ops"]


def box(frame, idx, centre, size=(2.0, 2.0, 2.0), angles=(0.0, 0.0, 0.0), label=0):
    return (frame, idx, label, *map(float, centre), *map(float, size), *map(float, angles))


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "events", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    rows = lambda it: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in it)
    assert rows(got.select(*names).collect()) == rows(want.project(", ".join(names)).fetchall())


def test_borders_count_and_frames_are_apart(spark):
    pts = spark.createDataFrame([(0, 1, 1.0, 0.0, 0.0), (0, 2, 1.001, 0.0, 0.0), (1, 3, 0.0, 0.0, 0.0)], "frame_id long, p long, x double, y double, z double")
    b = spark.createDataFrame([box(0, 7, (0, 0, 0)), box(0, 9, (0, 0, 0))], BOX)
    assert {(r.p, r.box_idx) for r in pairs.points_in_boxes(pts, b).collect()} == {(1, 7), (1, 9)}
    assert {(r.p, r.box_idx) for r in pairs.lowest_box(pts, b, ["p"]).collect()} == {(1, 7), (2, -1), (3, -1)}


def test_iou_of_known_boxes(spark):
    a = spark.createDataFrame([box(0, 1, (0, 0, 0))], BOX)
    b = spark.createDataFrame([box(0, 1, (0, 0, 0)), box(0, 2, (1, 0, 0)), box(0, 3, (1, 1, 1)), box(0, 4, (2, 0, 0)), box(0, 5, (0, 0, 0), angles=(np.pi / 4, 0, 0))], BOX)
    got = {r.b_box_idx: r.iou for r in pairs.oriented_iou(a, b).collect()}
    assert got.keys() == {1, 2, 3, 5}
    eighth = 16 * (np.sqrt(2) - 1)  # a square of side 2 and itself turned by 45 degrees, times the height
    for k, want in {1: 1.0, 2: 1 / 3, 3: 1 / 15, 5: eighth / (16 - eighth)}.items():
        assert got[k] == pytest.approx(want, abs=1e-9)
    assert {r.b_box_idx for r in pairs.overlapping(a, b).collect()} == {1, 2, 3, 4, 5}  # touching overlaps


def test_volume_against_sampling():
    rng = np.random.default_rng(5)

    def turned(y, p, r):
        cy, sy, cp, sp, cr, sr = np.cos(y), np.sin(y), np.cos(p), np.sin(p), np.cos(r), np.sin(r)
        return np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]])

    for _ in range(6):
        p, q = (np.concatenate((rng.normal(size=3) * 0.4, rng.uniform(1, 3, 3), turned(*rng.uniform(-3, 3, 3)).ravel())) for _ in range(2))
        s = rng.uniform(-3, 3, (500_000, 3))
        inside = lambda b: (np.abs((s - b[:3]) @ b[6:].reshape(3, 3)) <= b[3:6] / 2).all(axis=1)  # noqa: E731, B023
        share = (inside(p) & inside(q)).mean()
        assert pairs.common_volume(p, q) == pytest.approx(216 * share, abs=4 * 216 * np.sqrt(share / len(s)))
        assert pairs.common_volume(p, q) == pytest.approx(pairs.common_volume(q, p), abs=1e-9)


def test_suppress_equals_the_loop(spark):
    rng = np.random.default_rng(1)
    n = 60
    links = [(int(i), int(j)) for i, j in rng.integers(0, n, (140, 2)) if i < j]
    kept = []
    for k in range(n):
        if not any((a, k) in links for a in kept):
            kept.append(k)
    nodes = spark.createDataFrame([(k, k) for k in range(n)], "id long, rank long")
    got = greedy.suppress(nodes, spark.createDataFrame(links, "better long, worse long"))
    assert sorted(r.id for r in got.collect()) == kept
    assert greedy.suppress(nodes, spark.createDataFrame([], "better long, worse long")).count() == n


def test_assign_equals_the_loop(spark):
    rng = np.random.default_rng(2)
    edges = [(int(i), int(j), int(i), float(v), int(j)) for i in range(25) for j in range(15) if rng.random() < 0.3 for v in [rng.integers(0, 5)]]
    taken, want = set(), set()
    for i in range(25):
        free = [(v, j) for a, j, _, v, _ in edges if a == i and j not in taken]
        if free:
            taken.add(min(free)[1])
            want.add((i, min(free)[1]))
    got = greedy.assign(spark.createDataFrame(edges, "left long, right long, rank long, value double, tie long"))
    assert {(r.left, r.right) for r in got.collect()} == want


def test_voxel_edges(spark):
    pts = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 10.0, 0.0, 0.0), (0, 3, float("nan"), 0.0, 0.0), (0, 4, 9.99, 9.99, 9.99)], "frame_id long, p long, x double, y double, z double")
    got = voxels.with_cells(pts, (0, 0, 0), (10, 10, 10), (3, 3, 3))
    assert {(r.p, r.ix, r.iy, r.iz) for r in got.collect()} == {(1, 0, 0, 0), (4, 2, 2, 2)}
    with pytest.raises(ValueError):
        voxels.grid((0, 0, 0), (1, 1, 1), (3, 3, 3))


def test_conversions_and_refusals():
    assert geom.convert("xyzxyz", "XYZLWH")["cx"] == "(x1+x2)/2"
    with pytest.raises(NotImplementedError):
        geom.convert("XYZLWH", "XYZLWHY")
    with pytest.raises(NotImplementedError):
        geom.rotate_boxes((0, 0, 1), 0.1, "XYZLWH")
    with pytest.raises(ValueError):
        geom.rotate_boxes((1, 0, 0), 0.1, "XYZLWHY")
    with pytest.raises(TypeError):
        augment.refuse("MixUp")


def test_average_precision_cases(spark):
    curve = spark.createDataFrame([(0, 0.9, 1, True), (0, 0.8, 2, False), (1, 0.9, 3, True), (2, 0.5, 4, False)], "label long, score double, det_idx long, hit boolean")
    totals = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "label long, num_gt long")
    counted = detection.running(curve, ["label"], "score", "det_idx", "hit")
    assert {r.label: r.ap for r in detection.average_precision(counted, totals, ["label"], "all_points").collect()} == {0: 1.0, 1: 0.5, 2: -1.0}
    assert {r.label: round(r.ap, 6) for r in detection.average_precision(counted, totals, ["label"], "r40").collect()} == {0: 1.0, 1: 0.5, 2: -1.0}


def test_running_sums_in_ranges_equal_one_window(spark):
    """A class with most rows, few different scores, null scores and an empty table; ranges of 20 rows and one of all."""
    rows = spark.range(300).selectExpr("if(id % 5 = 0, id % 3, 7) AS label", "if(id % 50 = 1, null, (id * 7 % 4) / 4D) AS score", "id AS det_idx", "id % 3 = 0 AS hit")
    whole = {(r.det_idx, r.tp, r.seen) for r in detection.running(rows, ["label"], "score", "det_idx", "hit").collect()}
    cut = [(r.det_idx, r.tp, r.seen) for r in detection.running(rows, ["label"], "score", "det_idx", "hit", rows=20).collect()]
    assert len(cut) == 300 and set(cut) == whole
    order = sorted(rows.collect(), key=lambda r: (r.label, r.score is None, -(r.score or 0), r.det_idx))
    seen, want = {}, set()
    for r in order:
        tp, n = seen.get(r.label, (0, 0))
        seen[r.label] = tp + r.hit, n + 1
        want.add((r.det_idx, *seen[r.label]))
    assert whole == want
    assert detection.running(rows.limit(0), ["label"], "score", "det_idx", "hit", rows=20).count() == 0


def test_a_shared_rig_is_bounded(spark):
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "frame_id long, x double, y double, z double")
    with pytest.raises(ValueError):
        cameras.project(points, spark.range(cameras.RIG + 1).withColumnRenamed("id", "cam_idx"))


def test_perfect_detections_have_full_scores(spark):
    gt = spark.createDataFrame([box(f, 10 * f + k, (5 * k, f, 0), label=k) for f in range(3) for k in range(2)], BOX)
    pred = gt.withColumnRenamed("box_idx", "det_idx").withColumn("score", F.lit(0.9) - F.col("det_idx") / 1000)
    assert {round(r.ap, 6) for r in detection.nds_ap(pred, gt).collect()} == {1.0}
    whole = detection.map3d(pred, gt, (0.5,)).filter("label IS NULL AND iou IS NULL AND bin IS NULL").first()
    assert whole.ap == pytest.approx(1.0)


def test_jittered_pastes_are_the_loops(spark):
    """Kept boxes meet neither the frame's boxes nor each other, and no candidate with a free try is left out."""
    gt = spark.createDataFrame([box(0, 1, (0, 0, 0)), box(1, 2, (0, 0, 0))], BOX)
    stock = spark.createDataFrame([box(9, 10 + k, (0.5 * k, 0, 0)) for k in range(6)], BOX)
    for tries in (0, 8):
        placed = augment.place(gt, stock, {0: 5}, 3, (6.0, 6.0, 0.0), None if tries else 1.0, tries)
        rows = placed.withColumn("origin", F.lit(1)).collect()
        assert pairs.overlapping(placed, gt).count() == 0
        assert pairs.overlapping(placed, placed).filter("a_box_idx < b_box_idx").count() == 0
        assert len({(r.frame_id, r.box_idx) for r in rows}) == len(rows)
    assert len(rows) > 2
    values = [r.v for r in spark.range(200).select(augment.truncated_normal((F.col("id") + 0.5) / 200, -1.0, 2.0, 1.0).alias("v")).collect()]
    assert values == sorted(values) and -1 <= values[0] < -0.9 and 1.8 < values[-1] <= 2


def test_whole_stock_is_offered(spark):
    from cuboid.queries import QUERIES

    stock = spark.createDataFrame([(i, i % 3, 0) for i in range(100)], "box_idx long, label int, frame_id long")
    need = spark.createDataFrame([(f, c, m) for f in range(40) for c, m in ((0, 5), (1, 50), (2, 1))], "frame_id long, label int, missing long")
    got = augment.offered(need, stock, 7).collect()
    seen = {}
    for r in got:
        assert r.box_idx % 3 == r.label
        seen.setdefault((r.frame_id, r.label), []).append(r.box_idx)
    for f in range(40):
        assert [len(set(seen[f, c])) for c in range(3)] == [len(seen[f, c]) for c in range(3)] == [5, 33, 1]
    assert {r.box_idx for r in got if r.label == 0} == set(range(0, 100, 3))
    rows = QUERIES["copy_paste_place"](spark, "/root/testdata/sf0.01").collect()
    assert {r.box_idx % 10 for r in rows} - {3}


def plain_errors(pred, gt, below=2.0, start=11):
    """Matching, running means and interpolation for one class with numpy: the five mean errors."""
    taken, rows = set(), []
    for p in sorted(pred, key=lambda p: (-p["score"], -p["frame_id"], -p["det_idx"])):
        near = [(np.hypot(p["cx"] - g["cx"], p["cy"] - g["cy"]), g["box_idx"], g) for g in gt if g["frame_id"] == p["frame_id"] and g["box_idx"] not in taken]
        best = min(near, default=None, key=lambda x: x[:2])
        hit = best if best and best[0] < below else None
        if hit:
            taken.add(hit[1])
        rows.append((p, hit))
    tp = np.cumsum([h is not None for _, h in rows])
    if not len(rows) or not tp[-1]:
        return np.ones(5)
    grid = np.linspace(0, 1, 101)
    conf = np.interp(grid, tp / len(gt), [p["score"] for p, _ in rows], right=0)
    errors = []
    for p, h in rows:
        if h:
            g = h[2]
            small = np.prod([min(p[k], g[k]) for k in "lwh"])
            turn = abs((g["yaw"] - p["yaw"] + np.pi) % (2 * np.pi) - np.pi)
            union = np.prod([p[k] for k in "lwh"]) + np.prod([g[k] for k in "lwh"]) - small
            errors.append((h[0], np.hypot(p["vx"] - g["vx"], p["vy"] - g["vy"]), 1 - small / union, turn, np.nan if g["attr"] < 0 else float(p["attr"] != g["attr"])))
    errors, confs = np.array(errors), np.array([p["score"] for p, h in rows if h])
    last = np.flatnonzero(conf)[-1] if conf.any() else 0
    out = []
    for k in range(5):
        e = errors[:, k]
        num = np.cumsum(~np.isnan(e))
        mean = np.ones(len(e)) if not num[-1] else np.divide(np.nancumsum(e), num, out=np.zeros(len(e)), where=num > 0)
        out.append(1.0 if last < start else np.interp(conf[::-1], confs[::-1], mean[::-1])[::-1][start : last + 1].mean())
    return np.array(out)


def test_true_positive_errors_equal_plain_code(spark):
    from cuboid.plans.scene import view

    pred, gt = view(spark, SF, "pred"), view(spark, SF, "gt")
    ps, gs = [r.asDict() for r in pred.collect()], [r.asDict() for r in gt.collect()]
    got = {(r.label, r.metric): r.error for r in detection.tp_errors(pred, gt).collect()}
    for label in {p["label"] for p in ps} | {g["label"] for g in gs}:
        want = plain_errors([p for p in ps if p["label"] == label], [g for g in gs if g["label"] == label])
        assert [got[label, e] for e in detection.ERRORS] == pytest.approx(list(want), abs=1e-6), label


def test_perfect_score(spark):
    from cuboid.plans.scene import view

    gt = view(spark, SF, "gt").withColumn("attr", F.lit(1))
    pred = gt.withColumnRenamed("box_idx", "det_idx").withColumn("score", F.lit(0.9))
    row = detection.detection_score(pred, gt).first()
    assert row.mean_ap == pytest.approx(1.0) and row.score == pytest.approx(1.0)


def test_empty_tables(spark):
    b = spark.createDataFrame([], BOX)
    p = spark.createDataFrame([], "frame_id long, x double, y double, z double")
    assert pairs.points_in_boxes(p, b).count() == 0 and pairs.oriented_iou(b, b).count() == 0 and boxes.corners(b).count() == 0


def test_oriented_suppression_and_matching_equal_plain_loops(spark):
    for fmt, by_class in (("XYZLWHY", False), ("XYZLWHYPR", True)):
        pred = view(spark, SF, "pred")
        iou = {(r.a_det_idx, r.b_det_idx): r.iou for r in pairs.iou(pred, pred, ["label"] if by_class else None, fmt).collect()}
        kept = []
        for r in sorted(pred.collect(), key=lambda r: (-r.score, r.det_idx)):
            if all(iou.get((k, r.det_idx), 0) <= 0.1 for k in kept):
                kept.append(r.det_idx)
        assert {r.det_idx for r in detection.nms(pred, 0.1, by_class, fmt).collect()} == set(kept)
    gt, taken, want = view(spark, SF, "gt"), set(), set()
    near = {}
    for r in pairs.iou(pred, gt, ["label"]).filter("iou >= 0.1").collect():
        near.setdefault(r.a_det_idx, []).append((-r.iou, r.b_box_idx))
    for r in sorted(pred.collect(), key=lambda r: (-r.score, r.frame_id, r.det_idx)):
        free = [g for g in sorted(near.get(r.det_idx, [])) if g[1] not in taken]
        if free:
            taken.add(free[0][1])
            want.add((r.det_idx, free[0][1]))
    got = detection.match(detection.candidates_by_iou(pred, gt, 0.1))
    assert {(r.det_idx, r.gt_idx) for r in got.collect()} == want and want


def test_formats_and_filters(spark):
    corner = spark.createDataFrame([(0, 0, -1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "frame_id int, box_idx int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    flipped = boxes.flip_boxes(corner, "x", "XYZXYZ").first()
    assert (flipped.x1, flipped.x2, flipped.y1) == (-4.0, 1.0, 2.0)
    p = boxes.params(corner, "XYZXYZ").first()
    assert (p.cx, p.l, p.r00, p.r01, p.yaw) == (1.5, 5.0, 1.0, 0.0, 0.0)
    assert boxes.scale_boxes(corner, 2.0, "XYZXYZ").first().x2 == 8.0
    assert pairs.iou(corner, corner, fmt="XYZXYZ").first().iou == 1.0
    assert boxes.score_filter(spark.createDataFrame([(0.5,), (0.4,), (None,)], "score double"), 0.5).count() == 1
    assert pairs.min_points(view(spark, SF, "gt"), view(spark, SF, "points"), 0).count() == view(spark, SF, "gt").count()


def test_yaw_iou_equals_clipping(spark):
    """Random rectangles, and ones that share edges, corners and centres, turned by multiples of a right angle or not."""
    r = np.random.default_rng(11)
    a, b = [], []
    for i in range(400):
        if i % 2:
            p, q = ([*r.uniform(-3, 3, 3), *r.uniform(0.5, 6, 3), r.uniform(-7, 7)] for _ in range(2))
        else:
            turn = r.choice([0.0, 0.3])
            p, q = ([*r.integers(-2, 3, 3).astype(float), *r.integers(1, 4, 3).astype(float) * 2, r.integers(-3, 4) * np.pi / 2] for _ in range(2))
            for x in (p, q):
                x[0], x[1], x[6] = np.cos(turn) * x[0] - np.sin(turn) * x[1], np.sin(turn) * x[0] + np.cos(turn) * x[1], x[6] + turn
        a.append(box(i, i, tuple(map(float, p[:3])), tuple(map(float, p[3:6])), (float(p[6]), 0.0, 0.0)))
        b.append(box(i, i, tuple(map(float, q[:3])), tuple(map(float, q[3:6])), (float(q[6]), 0.0, 0.0)))
    a, b = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    got = {x.frame_id: x.iou for x in pairs.yaw_iou(a, b).collect()}
    want = {x.frame_id: x.iou for x in pairs.oriented_iou(a, b).collect()}
    assert len(want) > 200
    for k in got.keys() | want.keys():
        assert got.get(k, 0.0) == pytest.approx(want.get(k, 0.0), abs=1e-7), k


def test_boxes_of_all_sizes_meet(spark):
    """Boxes from centimetres to a thousand kilometres, none with more than a few rows of cells; odd ones meet nothing."""
    from cuboid.operators.pairs import _cells

    r = np.random.default_rng(12)
    size = lambda: tuple(float(x) for x in 10 ** r.uniform(-2, 6) * r.uniform(0.5, 1, 3))
    data = [box(i % 2, i, tuple(float(x) for x in r.normal(size=3) * 10 ** r.uniform(0, 5)), size()) for i in range(300)]
    data += [box(0, 1000, (float("nan"), 0.0, 0.0)), box(0, 1001, (0.0, 0.0, 0.0), (float("inf"), 1.0, 1.0)), box(0, 1002, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0))]
    df = spark.createDataFrame(data, BOX)
    assert _cells(df, 8.0).groupBy("box_idx").count().agg({"count": "max"}).first()[0] <= 16
    flat = {x.box_idx: x for x in df.collect()}
    meets = lambda p, q: all(abs(getattr(p, c) - getattr(q, c)) <= (getattr(p, s) + getattr(q, s)) / 2 for c, s in (("cx", "l"), ("cy", "w"), ("cz", "h")))
    want = {(i, j) for i, p in flat.items() for j, q in flat.items() if p.frame_id == q.frame_id and i not in (1000, 1001) and j not in (1000, 1001) and meets(p, q)}
    assert {(x.a_box_idx, x.b_box_idx) for x in pairs.overlapping(df, df).collect()} == want and len(want) > 1000
    points = spark.createDataFrame([(i % 2, i, *(float(x) for x in r.normal(size=3) * 10 ** r.uniform(0, 5))) for i in range(400)], "frame_id long, p long, x double, y double, z double")
    inside = lambda p, q: abs(p.x - q.cx) <= q.l / 2 and abs(p.y - q.cy) <= q.w / 2 and abs(p.z - q.cz) <= q.h / 2
    want = {(p.p, j) for p in points.collect() for j, q in flat.items() if j not in (1000, 1001) and p.frame_id == q.frame_id and inside(p, q)}
    assert {(x.p, x.box_idx) for x in pairs.points_in_boxes(points, df).collect()} == want and len(want) > 1000


def test_score_options_equal_plain_sums(spark):
    """Classes, metrics and skips put together by hand from the parts of the score."""
    pred, gt = view(spark, SF, "pred"), view(spark, SF, "gt")
    how = detection.Scoring((0, 1, 2, 77), (1.0, 2.0), 2.0, weight=3.0, metrics=("trans", "orient"), half_turn=(1,), skips=((2, "orient"), (77, "trans")))
    got = detection.detection_score(pred, gt, how).first()
    ap = {(r.label, r.threshold): r.ap for r in detection.nds_ap(pred, gt, (1.0, 2.0)).collect()}
    mean_ap = sum(ap.get((c, t), 0.0) for c in (0, 1, 2, 77) for t in (1.0, 2.0)) / 8
    errors = {(r.label, r.metric): r.error for r in detection.tp_errors(pred, gt, 2.0, half_turn=(1,)).collect()}
    trans = sum(errors[c, "trans"] for c in (0, 1, 2)) / 3
    orient = (errors[0, "orient"] + errors[1, "orient"] + 1.0) / 3  # no box of class 77: error 1
    assert (got.mean_ap, got.trans, got.orient) == pytest.approx((mean_ap, trans, orient))
    assert got.score == pytest.approx((3 * mean_ap + max(0, 1 - trans) + max(0, 1 - orient)) / 5)


def test_a_metric_skipped_everywhere_adds_nothing(spark):
    pred, gt = view(spark, SF, "pred"), view(spark, SF, "gt")
    got = detection.detection_score(pred, gt, detection.Scoring((0,), metrics=("vel", "trans"), skips=((0, "vel"),))).first()
    assert got.vel is None and got.score == pytest.approx((5 * got.mean_ap + max(0, 1 - got.trans)) / 7)


def test_scoring_presets_and_refusals():
    how = detection.Scoring.of_names(["car", "barrier", "traffic_cone"], weight=2.0)
    assert (how.classes, how.half_turn, how.weight) == ((0, 1, 2), (1,), 2.0)
    assert set(how.skips) == {(1, "attr"), (1, "vel"), (2, "attr"), (2, "vel"), (2, "orient")}
    for bad in ({"below": 3.0}, {"metrics": ("trans", "colour")}, {"classes": ()}, {"skips": ((1, "x"),)}):
        with pytest.raises(ValueError):
            detection.Scoring(**bad)


def test_points_on_the_border_of_an_image(spark, tmp_path):
    """Points that lie on the right or lower border of an image are outside in fov_filter as in its SQL, however rounded."""
    for t in ("nation", "embeddings"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    at = [(-7.5, 4.8, 0.68), (-16.25, 10.4, 0.68), (-7.5, 4.79, 0.68), (2.0, 0.0, -0.96), (2.0, 0.0, -0.92)]
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    rows = [(0, 0, round(100 * y + 4000) * pow(101, -1, 8000), k, float(round(25 * z + 25)), x + 40, 0.0, 0.0) for k, (x, y, z) in enumerate(at)]
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t, files in (("nation", ""), ("embeddings", ""), ("lineitem", "/*.parquet")):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{files}'")
    got = {(r.frame_id, r.cam_idx): r.n for r in QUERIES["fov_filter"](spark, str(tmp_path)).collect()}
    assert got == {(f, c): n for f, c, n in con.sql(ORACLE_SQL["fov_filter"]).fetchall()} and got[0, 3] == 1 and got[0, 0] == 1
    seen = cameras.project(view(spark, str(tmp_path), "points"), cameras.extrinsics(view(spark, str(tmp_path), "cams")))
    assert cameras.in_view(seen).filter("cam_idx = 3").count() > 1  # to the last bit, one of the first two lies inside
