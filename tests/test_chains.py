"""Linked lists, poses and sweeps against plain code, and a written data set with two scenes."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuboid.functions import rigid
from cuboid.operators import chains
from cuboid.operators.boxes import with_exprs
from cuboid.sources import nuscenes


def lists(seed, sizes):
    """(token, prev) rows of lists in random order, and what ranked() should say of them."""
    r = random.Random(seed)
    tokens = [f"t{i}" for i in range(sum(sizes))]
    r.shuffle(tokens)
    rows, want = [], {}
    for size in sizes:
        mine, tokens = tokens[:size], tokens[size:]
        start = r.choice([None, "", "gone"])
        rows += [(t, mine[i - 1] if i else start) for i, t in enumerate(mine)]
        want |= {t: (mine[0], i) for i, t in enumerate(mine)}
    r.shuffle(rows)
    return rows, want


def test_ranked_equals_walking(spark):
    rows, want = lists(1, [1, 2, 3, 700, 64, 65, 1, 17])
    got = {r.token: (r.head, r.position) for r in chains.ranked(spark.createDataFrame(rows, "token string, prev string")).collect()}
    assert got == want


def test_ranked_refuses_circles_and_takes_nothing(spark):
    with pytest.raises(ValueError):
        chains.ranked(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "token long, prev long"))
    assert chains.ranked(spark.createDataFrame([], "token long, prev long")).count() == 0
    assert [tuple(r) for r in chains.ranked(spark.createDataFrame([(7, None)], "token long, prev long")).collect()] == [(7, 7, 0)]


def test_latest_stops_at_a_lists_start(spark):
    rows, want = lists(2, [5, 1, 9])
    ranks = chains.ranked(spark.createDataFrame(rows, "token string, prev string"))
    at = {(h, p): t for t, (h, p) in want.items()}
    expected = sorted((t, at[h, p - b], b) for t, (h, p) in want.items() for b in range(4) if p >= b)
    assert sorted(map(tuple, chains.latest(ranks.select("token"), ranks, 4).collect())) == expected
    with pytest.raises(ValueError):
        chains.latest(ranks, ranks, 0)


def matrix(q, t):
    w, x, y, z = q
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = t
    return m


def pose(r):
    q = r.normal(size=4)
    return (q / np.linalg.norm(q)).tolist(), r.uniform(-500, 500, 3).tolist()


def test_products_and_inverses(spark):
    r = np.random.default_rng(4)
    poses = [[pose(r) for _ in range(3)] for _ in range(20)]
    df = spark.createDataFrame([(i, *[v for qt in p for v in qt]) for i, p in enumerate(poses)], "i int, q0 array<double>, t0 array<double>, q1 array<double>, t1 array<double>, q2 array<double>, t2 array<double>")
    for k in range(3):
        df = with_exprs(df, rigid.of_pose("abc"[k], f"q{k}", f"t{k}"))
    for steps, want in {("a", "-b", "c"): lambda a, b, c: a @ np.linalg.inv(b) @ c, ("-a",): lambda a, b, c: np.linalg.inv(a), ("b",): lambda a, b, c: b, ("-c", "-b", "a", "a"): lambda a, b, c: np.linalg.inv(c) @ np.linalg.inv(b) @ a @ a}.items():
        for row in rigid.chain(df, "e", *steps).collect():
            m = want(*[matrix(*qt) for qt in poses[row.i]])
            assert [row[c] for c in rigid.names("e")] == pytest.approx(m[:3].ravel().tolist(), abs=1e-8)
    out = with_exprs(df.withColumns({"x": F.lit(1.0), "y": F.lit(2.0), "z": F.lit(3.0)}), rigid.moved("a")).orderBy("i").first()
    assert [out.x, out.y, out.z] == pytest.approx((matrix(*poses[0][0]) @ [1, 2, 3, 1])[:3].tolist())


@pytest.fixture(scope="module")
def drive(tmp_path_factory):
    """Two scenes of three and two key frames with two sweeps in between; every sensor has its own pose and time, token
    order and file order tell nothing about time."""
    root, r = tmp_path_factory.mktemp("drive"), np.random.default_rng(6)
    (root / "v1").mkdir()
    for d in ("samples", "sweeps"):
        (root / d / "LIDAR_TOP").mkdir(parents=True)
    mounts = {"lidar": pose(r), "cam": pose(r)}
    k = [[900.0, 1.5, 800.0], [0.0, 905.0, 450.0], [0.0, 0.0, 1.0]]
    t = {
        "sensor": [{"token": "sl", "channel": "LIDAR_TOP", "modality": "lidar"}, {"token": "sc", "channel": "CAM_FRONT", "modality": "camera"}],
        "calibrated_sensor": [{"token": f"k{n}", "sensor_token": f"s{n[0]}", "rotation": q, "translation": x, "camera_intrinsic": k if n == "cam" else []} for n, (q, x) in mounts.items()],
        "scene": [], "sample": [], "sample_data": [], "ego_pose": [],
    }
    truth, number = {}, iter(r.permutation(1000).tolist())
    for s, frames in enumerate((3, 2)):
        samples = [f"m{next(number)}" for _ in range(frames)]
        t["scene"].append({"token": f"scene{s}", "name": f"scene-{s}", "first_sample_token": samples[0]})
        before = ""
        for f, sample in enumerate(samples):
            t["sample"].append({"token": sample, "timestamp": 7, "prev": samples[f - 1] if f else "", "next": samples[f + 1] if f + 1 < frames else "", "scene_token": f"scene{s}"})
            for sweep in range(3 if f + 1 < frames else 1):
                token, key = f"d{next(number)}", sweep == 0
                q, x = pose(r)
                time = 1_000_000 * s + 500_000 * f + 150_000 * sweep
                name = f"{'samples' if key else 'sweeps'}/LIDAR_TOP/{token}.bin"
                cloud = r.normal(size=(4, 5)).astype("<f4")
                cloud.tofile(root / name)
                t["ego_pose"].append({"token": f"e{token}", "timestamp": time, "rotation": q, "translation": x})
                t["sample_data"].append({"token": token, "sample_token": sample, "ego_pose_token": f"e{token}", "calibrated_sensor_token": "klidar", "timestamp": time, "is_key_frame": key, "filename": name, "prev": before, "next": ""})
                truth[token] = (sample if key else None, before, time, matrix(q, x) @ matrix(*mounts["lidar"]), cloud)
                before = token
            q, x = pose(r)
            t["ego_pose"].append({"token": f"ec{sample}", "timestamp": 1, "rotation": q, "translation": x})
            t["sample_data"].append({"token": f"c{sample}", "sample_token": sample, "ego_pose_token": f"ec{sample}", "calibrated_sensor_token": "kcam", "timestamp": 1, "is_key_frame": True, "width": 1600, "height": 900, "prev": "", "next": ""})
            truth[f"c{sample}"] = matrix(q, x) @ matrix(*mounts["cam"])
    for name, rows in t.items():
        order = r.permutation(len(rows))
        (root / f"v1/{name}.json").write_text(json.dumps([rows[i] for i in order]))
    return str(root), t, truth


def test_frames_follow_the_links(spark, drive):
    root, t, _ = drive
    got = {(r.scene, r.sample_token): r.frame for r in nuscenes.frames(spark, root, "v1").collect()}
    assert sorted(got.values()) == [0, 0, 1, 1, 2]
    prev = {s["token"]: s["prev"] for s in t["sample"]}
    place = lambda s: 0 if not prev[s] else 1 + place(prev[s])
    assert all(frame == place(sample) for (_, sample), frame in got.items())
    assert {r.scene for r in nuscenes.frames(spark, root, "v1", ["scene-1"]).collect()} == {"scene-1"}


def test_sweeps_in_the_key_frame(spark, drive):
    root, _, truth = drive
    want = {}
    for token, row in truth.items():
        if isinstance(row, tuple) and row[0]:
            at, back = token, 0
            while at and back < 4:
                move = np.linalg.inv(row[3]) @ truth[at][3]
                for i, p in enumerate(truth[at][4]):
                    want[row[0], back, i] = [*(move @ [*p[:3], 1])[:3], *p[3:], (row[2] - truth[at][2]) / 1e6]
                at, back = truth[at][1], back + 1
    got = {(r.sample_token, r.back, r.pt_idx): [r.x, r.y, r.z, r.intensity, r.ring, r.dt] for r in nuscenes.sweep_points(spark, root, "v1", 4).collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, rel=1e-5, abs=1e-3)
    assert {r.back for r in nuscenes.sweep_points(spark, root, "v1", 1).collect()} == {0}


def test_lidar_to_camera(spark, drive):
    root, _, truth = drive
    lidar = {row[0]: row[3] for row in truth.values() if isinstance(row, tuple) and row[0]}
    rows = nuscenes.cameras(spark, root, "v1").collect()
    assert len(rows) == 5
    for r in rows:
        assert [r[c] for c in rigid.names("e")] == pytest.approx((np.linalg.inv(truth[f"c{r.sample_token}"]) @ lidar[r.sample_token])[:3].ravel().tolist(), abs=1e-6)
        assert (r.img_w, r.img_h, r.fx, r.skew, r.cx0, r.fy, r.cy0) == (1600, 900, 900.0, 1.5, 800.0, 905.0, 450.0)
