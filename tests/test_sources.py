"""Readers on tiny trees written here, and the stream."""

import json
import math

import duckdb
import numpy as np
import pytest

from cuboid.queries import ORACLE_SQL, QUERIES
from cuboid.sources import kitti, nuscenes

SF = "/root/testdata/sf0.001"


def test_kitti_tree(spark, tmp_path):
    top = tmp_path / "training"
    for d in ("velodyne", "calib", "label_2"):
        (top / d).mkdir(parents=True)
    rng = np.random.default_rng(0)
    cloud = rng.normal(size=(50, 4)).astype("<f4")
    cloud.tofile(top / "velodyne/000000.bin")
    p2 = [700.0, 0, 600, 45, 0, 700, 180, -0.3, 0, 0, 1, 0.005]
    turn = [0.0, -1, 0, 0.1, 0, 0, -1, -0.2, 1, 0, 0, -0.3]
    lines = {"P2": p2, "R0_rect": np.eye(3).ravel(), "Tr_velo_to_cam": turn}
    (top / "calib/000000.txt").write_text("".join(f"{k}: {' '.join(map(str, v))}\n" for k, v in lines.items()))
    (top / "label_2/000000.txt").write_text("Car 0 0 0 1 2 3 4 1.5 1.6 4.0 2.0 1.0 10.0 0.3\nDontCare 0 0 0 0 0 0 0 -1 -1 -1 -1 -1 -1 -1\nBoat 0 0 0 1 2 3 4 1 1 1 0 0 5 0\n")
    got = kitti.points(spark, str(tmp_path)).orderBy("pt_idx").toPandas()
    assert np.array_equal(got[["x", "y", "z", "intensity"]].to_numpy(np.float32), cloud) and set(got.frame_id) == {"000000"}
    k = np.array(p2).reshape(3, 4)
    e = np.eye(4)
    e[:3] = np.array(turn).reshape(3, 4)
    e[:3, 3] += np.linalg.solve(k[:, :3], k[:, 3])
    cam = kitti.cameras(spark, str(tmp_path)).first()
    assert [cam[f"e{i}{j}"] for i in range(3) for j in range(4)] == pytest.approx(e[:3].ravel())
    boxes = {r.label: r for r in kitti.boxes(spark, str(tmp_path)).collect()}
    centre = np.linalg.inv(e) @ [2.0, 1.0 - 0.75, 10.0, 1]
    assert boxes.keys() == {0, -1}
    assert (boxes[0].cx, boxes[0].cy, boxes[0].cz) == pytest.approx(tuple(centre[:3]))
    assert (boxes[0].l, boxes[0].w, boxes[0].h) == (4.0, 1.6, 1.5) and boxes[0].yaw == pytest.approx(-0.3 - math.pi / 2)


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x02\0\0\0"


def jpeg(w, h):
    app, huffman = b"\xff\xe0\0\x10JFIF\0" + bytes(9), b"\xff\xc4\0\x04\0\0"
    return b"\xff\xd8" + app + huffman + b"\xff\xff\xc2\0\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes(10)


def test_image_headers():
    assert kitti.header_size(png(1242, 375)) == (1242, 375) == kitti.header_size(jpeg(1242, 375))
    for bad in (b"", b"GIF89a" + bytes(20), png(5, 5)[:20], jpeg(5, 5)[:25], b"\xff\xd8" + bytes(30)):
        assert kitti.header_size(bad) is None


def test_points_in_view(spark, tmp_path):
    """Frames with a PNG, with a JPEG, with a broken image and without one; the wrong camera's image does not count."""
    top, rng = tmp_path / "training", np.random.default_rng(1)
    for d in ("velodyne", "calib", "image_2", "image_3"):
        (top / d).mkdir(parents=True)
    k, turn = np.array([[50.0, 0, 20, 0], [0, 50, 10, 0], [0, 0, 1, 0]]), np.array([[0.0, -1, 0, 0], [0, 0, -1, 0], [1, 0, 0, 0]])
    clouds = {}
    for i, image in enumerate((png(40, 20), jpeg(30, 25), b"broken", None)):
        clouds[f"{i:06}"] = rng.uniform(-5, 5, (200, 4)).astype("<f4")
        clouds[f"{i:06}"].tofile(top / f"velodyne/{i:06}.bin")
        (top / f"calib/{i:06}.txt").write_text("".join(f"{n}: {' '.join(map(str, v.ravel()))}\n" for n, v in {"P2": k, "R0_rect": np.eye(3), "Tr_velo_to_cam": turn}.items()))
        (top / f"image_3/{i:06}.png").write_bytes(png(9, 9))
        if image is not None:
            (top / f"image_2/{i:06}.{'jpg' if i == 1 else 'png'}").write_bytes(image)
    sizes = {"000000": (40, 20), "000001": (30, 25), "000002": (1, 1), "000003": (1, 1)}
    assert {r.frame_id: (r.img_w, r.img_h) for r in kitti.sized_cameras(spark, str(tmp_path)).collect()} == sizes
    want = set()
    for frame, cloud in clouds.items():
        for n, (x, y, z, _) in enumerate(cloud.astype(float)):
            if x > 0 and 0 <= 50 * -y / x + 20 < sizes[frame][0] and 0 <= 50 * -z / x + 10 < sizes[frame][1]:
                want.add((frame, n))
    assert {(r.frame_id, r.pt_idx) for r in kitti.points_in_view(spark, str(tmp_path)).collect()} == want
    assert len({f for f, _ in want}) >= 2


def test_nuscenes_tables(spark, tmp_path):
    half = [math.cos(math.pi / 4), 0, 0, math.sin(math.pi / 4)]  # 90 degrees about z
    still = {"translation": [0.0, 0, 0], "rotation": [1.0, 0, 0, 0]}
    tables = {
        "category": [{"token": "c1", "name": "vehicle.car"}, {"token": "c2", "name": "animal"}],
        "instance": [{"token": "i1", "category_token": "c1"}, {"token": "i2", "category_token": "c2"}],
        "sensor": [{"token": "s1", "channel": "LIDAR_TOP", "modality": "lidar"}],
        "calibrated_sensor": [{"token": "k1", "sensor_token": "s1", "translation": [1.0, 0, 2], "rotation": [1.0, 0, 0, 0], "camera_intrinsic": []}],
        "ego_pose": [{"token": "e1", "timestamp": 5, "translation": [100.0, 50, 0], "rotation": half}],
        "scene": [{"token": "t1", "name": "scene-1", "first_sample_token": "a"}, {"token": "t2", "name": "scene-2"}],
        "sample": [{"token": "b", "timestamp": 9, "scene_token": "t1"}, {"token": "a", "timestamp": 5, "scene_token": "t1"}, {"token": "z", "timestamp": 1, "scene_token": "t2"}],
        "sample_data": [{"token": "d1", "sample_token": "a", "ego_pose_token": "e1", "calibrated_sensor_token": "k1", "timestamp": 5, "is_key_frame": True}],
        "sample_annotation": [{"token": "x1", "sample_token": "a", "instance_token": "i1", "size": [1.5, 4.0, 1.2], **still | {"translation": [100.0, 56, 3]}},
                              {"token": "x2", "sample_token": "a", "instance_token": "i2", "size": [1.0, 1, 1], **still}],
    }
    (tmp_path / "v1").mkdir()
    for name, rows in tables.items():
        (tmp_path / f"v1/{name}.json").write_text(json.dumps(rows))
    (row,) = nuscenes.annotations(spark, str(tmp_path), "v1").collect()
    # 6 m ahead of the turned car, whose lidar sits 1 m ahead of and 2 m above its origin
    assert (row["class"], row.l, row.w, row.h) == ("car", 4.0, 1.5, 1.2)
    assert (row.cx, row.cy, row.cz) == pytest.approx((5.0, 0.0, 1.0)) and row.yaw == pytest.approx(-math.pi / 2)
    assert [r.sample_token for r in nuscenes.frames(spark, str(tmp_path), "v1", ["scene-1"]).orderBy("frame").collect()] == ["a", "b"]


def test_stream_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = QUERIES["stream_object_db"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLE_SQL["stream_object_db"]).fetchall())
