"""Copy-paste of objects with their points, positions in large groups, exact quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuboid.operators import pairs
from cuboid.operators.order import numbered, quantile
from cuboid.operators.paste import Bank, object_bank, paste

BOXES = "frame_id long, box_idx long, label long, cx double, cy double, cz double, l double, w double, h double, yaw double, pitch double, roll double"
POINTS = "frame_id long, pt_idx long, x double, y double, z double, f double"


def scene(spark, frames=3, per_box=6, seed=1):
    """Frames with boxes 10 metres apart, each with points, and points outside. Frame 0 has class 1 only."""
    r = np.random.default_rng(seed)
    boxes, points = [], []
    for f in range(frames):
        k = 0
        for b in range(4):
            centre = np.array([10.0 * b + 200 * f, 3.0 * f, 0.0])
            boxes.append((f, 10 * f + b, 1 if f == 0 else 1 + b % 2, *centre.tolist(), 4.0, 2.0, 2.0, 0.3 * b, 0.0, 0.0))
            for _ in range(per_box - b):
                points.append((f, k, *(centre + r.uniform(-0.7, 0.7, 3)).tolist(), float(k)))
                k += 1
        for _ in range(5):
            points.append((f, k, *(np.array([300.0 + 200 * f, 90.0, 0]) + r.uniform(-1, 1, 3)).tolist(), float(k)))
            k += 1
    return spark.createDataFrame(boxes, BOXES), spark.createDataFrame(points, POINTS)


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_bank_filters_and_caps(spark):
    boxes, points = scene(spark)
    bank = object_bank(boxes, points, 4)
    assert rows(bank.entries, "box_idx", "n_points") == [(10 * f + b, 6 - b) for f in range(3) for b in range(3)]
    assert bank.points.count() == 3 * (6 + 5 + 4)
    small = object_bank(boxes, points, 3, size=2)
    assert rows(small.entries, "label", "box_idx") == [(1, 20), (1, 22), (2, 21), (2, 23)]
    assert {r.obj for r in small.points.collect()} == {20, 21, 22, 23}
    alone = object_bank(boxes, None)
    assert alone.points is None and alone.entries.count() == 12


def test_a_point_belongs_to_the_lowest_box(spark):
    boxes = spark.createDataFrame([(0, i, 1, 0.5 * i, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0, 0.0, 0.0) for i in (3, 1, 2)], BOXES)
    points = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, 0.0)], POINTS)
    assert rows(object_bank(boxes, points, 1).entries, "box_idx") == [(1,)]


def test_pasted_frames(spark):
    boxes, points = scene(spark)
    bank = object_bank(boxes, points, 1)
    new, pts = (x.cache() for x in paste(boxes, points, bank, {2: 2, 1: 9}, seed=3))
    got = new.orderBy("frame_id", "box_idx").collect()
    for f in range(3):
        mine = [r for r in got if r.frame_id == f]
        assert [r.box_idx for r in mine] == list(range(len(mine)))
        assert all(r.source is None for r in mine[:4]) and all(r.source is not None for r in mine[4:])
        assert [r.label for r in mine[4:]] == sorted((r.label for r in mine[4:]), reverse=True)  # classes in the order of targets
    assert sum(r.label == 2 for r in got if r.frame_id == 0) == 2
    assert all(r.source // 10 != r.frame_id for r in got if r.source is not None)  # a frame's own objects meet themselves
    ids = new.withColumnRenamed("source", "s")
    assert pairs.overlapping(ids, ids).filter("a_box_idx < b_box_idx").count() == 0
    entries = {r.box_idx: r.n_points for r in bank.entries.collect()}
    for f in range(3):
        mine = sorted((r for r in pts.collect() if r.frame_id == f), key=lambda r: r.pt_idx)
        assert [r.pt_idx for r in mine] == list(range(len(mine)))
        old = [r for r in mine if r.source is None]
        assert mine[: len(old)] == old and [r.f for r in old] == sorted(r.f for r in old)
        want = {r.source: entries[r.source] for r in got if r.frame_id == f and r.source is not None}
        have = {s: sum(r.source == s for r in mine) for s in want}
        assert have == want and len(mine) == len(old) + sum(want.values())


def test_scene_points_inside_pasted_boxes_go(spark):
    """A frame with points but no box where the object lands."""
    boxes = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0), (1, 1, 5, 50.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0)], BOXES)
    points = spark.createDataFrame([(0, 0, 0.5, 0.0, 0.0, 7.0), (1, 0, 0.1, 0.1, 0.1, 1.0), (1, 1, 1.0, 1.0, 1.0, 2.0), (1, 2, 1.1, 1.0, 1.0, 3.0)], POINTS)
    bank = object_bank(boxes.filter("frame_id = 0"), points, 1)
    _, pts = paste(boxes, points, bank, {1: 1})
    assert rows(pts.filter("frame_id = 1"), "pt_idx", "x", "f") == [(0, 1.1, 3.0), (1, 0.5, 7.0)]  # borders count
    _, pts = paste(boxes, points, Bank(bank.entries, None), {1: 1})
    assert rows(pts.filter("frame_id = 1"), "pt_idx", "x") == [(0, 1.1)]
    new, none = paste(boxes, None, bank, {1: 1})
    assert none is None and new.filter("frame_id = 1").count() == 2


def test_points_follow_moved_boxes(spark):
    boxes, points = scene(spark)
    bank = object_bank(boxes, points, 1)
    new, pts = paste(boxes, points, bank, {1: 6}, seed=2, reach=(3.0, 3.0, 0.5), attempts=4)
    own = {r.box_idx: r for r in bank.entries.collect()}
    origin = {(r.obj, r.f): r for r in bank.points.collect()}
    moved = {(r.frame_id, r.source): [getattr(r, c) - getattr(own[r.source], c) for c in ("cx", "cy", "cz")] for r in new.filter("source is not null").collect()}
    assert moved and any(max(map(abs, d)) > 0.01 for d in moved.values())
    for r in pts.filter("source is not null").collect():
        o = origin[r.source, r.f]
        assert [r.x - o.x, r.y - o.y, r.z - o.z] == pytest.approx(moved[r.frame_id, r.source], abs=1e-9)


def test_chance_and_absent_classes(spark):
    boxes, points = scene(spark, frames=12)
    bank = object_bank(boxes, points, 1)
    new, pts = paste(boxes, points, bank, {1: 9}, p=0.0)
    assert new.filter("source is not null").count() == 0 and pts.count() == points.count()
    new, _ = paste(boxes, points, bank, {7: 3})
    assert new.filter("source is not null").count() == 0
    new, _ = paste(boxes, points, bank, {1: 9}, p=0.5, seed=4)
    assert 0 < new.filter("source is not null").select("frame_id").distinct().count() < 12
    again, _ = paste(boxes.repartition(7), points.repartition(5), bank, {1: 9}, p=0.5, seed=4)
    assert rows(new.na.fill(-1), "frame_id", "box_idx", "source") == rows(again.na.fill(-1), "frame_id", "box_idx", "source")


def test_refusals_and_empty_tables(spark):
    boxes, points = scene(spark)
    for bad in (dict(min_points=0), dict(size=0)):
        with pytest.raises(ValueError):
            object_bank(boxes, points, **bad)
    bank = object_bank(boxes, points)
    with pytest.raises(ValueError):
        paste(boxes, points, bank, {1: 2}, p=1.5)
    with pytest.raises(ValueError):
        paste(boxes, points, bank, {1: 9}, reach=(1.0, 1.0, 1.0), std=0.0, attempts=2)
    none = object_bank(boxes.limit(0), points.limit(0))
    assert none.entries.count() == none.points.count() == 0
    new, pts = paste(boxes, points, none, {1: 9})
    assert (new.count(), pts.count()) == (boxes.count(), points.count())
    new, pts = paste(boxes.limit(0), points.limit(0), bank, {1: 9})
    assert new.count() == pts.count() == 0


def test_points_are_not_worked_out_again_and_again(spark):
    """The bank keeps its points with their columns, and pasting numbers the scene's in one pass; gaps in pt_idx close."""
    boxes, points = scene(spark)
    points = points.withColumns({"pt_idx": F.expr("pt_idx * 3001"), "f": F.expr("f + length(concat('marker', frame_id)) - 7")})
    bank = object_bank(boxes, points, 1)
    used = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("marker")
    _, pts = paste(boxes, points, bank, {2: 2, 1: 9}, seed=3)
    assert used(bank.points) == 0 and used(pts) <= 1
    assert all(r.pt_idx == 3001 * r.f for r in bank.points.collect())
    held = {r.box_idx: r.n_points for r in bank.entries.collect()}
    for f in range(3):
        mine = sorted((r for r in pts.collect() if r.frame_id == f), key=lambda r: r.pt_idx)
        old = [r.f for r in mine if r.source is None]
        assert [r.pt_idx for r in mine] == list(range(len(mine))) and old == sorted(old)
        assert all(r.source is not None for r in mine[len(old) :])
        assert len(mine) - len(old) == sum(held[s] for s in {r.source for r in mine[len(old) :]})


def test_numbered(spark):
    r = np.random.default_rng(2)
    data = [(int(g), float(v), i) for i, (g, v) in enumerate(zip(r.integers(0, 3, 5000) ** 2, r.normal(size=5000).round(2)))]
    df = spark.createDataFrame(data, "g int, v double, i int").repartition(9)
    got = {x.i: x.n for x in numbered(df, ["g"], F.floor(F.col("v") * 4), ["v", "i"], "n").collect()}
    for g in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == g), key=lambda d: d[1:])
        assert [got[d[2]] for d in mine] == list(range(len(mine)))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.98, 1.0])
def test_quantile(spark, q):
    r = np.random.default_rng(3)
    groups = {0: r.normal(size=3000), 1: np.array([5.0]), 2: np.array([1.0] * 40 + [2.0]), 3: r.integers(0, 3, 500).astype(float), 4: np.array([0.0, 1e9])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g int, v double")
    got = {x.g: x.v for x in quantile(df, ["g"], "v", q, cells=16).collect()}
    assert got == pytest.approx({g: float(np.quantile(v, q)) for g, v in groups.items()})
