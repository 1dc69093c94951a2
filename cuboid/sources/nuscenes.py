"""Reader of the nuScenes tables (JSON arrays) and their joins into lidar-frame annotations and camera poses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuboid.functions import rigid
from cuboid.operators import chains
from cuboid.operators.boxes import with_exprs
from cuboid.plans.tables import saved
from cuboid.sources.kitti import binary_points

_POSE = "translation array<double>, rotation array<double>"
#: The public schemas of the tables.
SCHEMAS = {
    "category": "token string, name string, description string",
    "instance": "token string, category_token string, nbr_annotations long, first_annotation_token string, last_annotation_token string",
    "sensor": "token string, channel string, modality string",
    "calibrated_sensor": f"token string, sensor_token string, {_POSE}, camera_intrinsic array<array<double>>",
    "ego_pose": f"token string, timestamp long, {_POSE}",
    "scene": "token string, log_token string, nbr_samples long, first_sample_token string, last_sample_token string, name string, description string",
    "sample": "token string, timestamp long, prev string, next string, scene_token string",
    "sample_data": "token string, sample_token string, ego_pose_token string, calibrated_sensor_token string, timestamp long, fileformat string, "
    "is_key_frame boolean, height int, width int, filename string, prev string, next string",
    "sample_annotation": f"token string, sample_token string, instance_token string, visibility_token string, attribute_tokens array<string>, {_POSE}, size array<double>, "
    "prev string, next string, num_lidar_pts long, num_radar_pts long",
}
#: Detection classes by category.
DETECTION = {
    "vehicle.car": "car", "vehicle.truck": "truck", "vehicle.bus.bendy": "bus", "vehicle.bus.rigid": "bus", "vehicle.trailer": "trailer", "vehicle.construction": "construction_vehicle",
    "human.pedestrian.adult": "pedestrian", "human.pedestrian.child": "pedestrian", "human.pedestrian.construction_worker": "pedestrian", "human.pedestrian.police_officer": "pedestrian",
    "vehicle.motorcycle": "motorcycle", "vehicle.bicycle": "bicycle", "movable_object.trafficcone": "traffic_cone", "movable_object.barrier": "barrier",
}


def table(spark: SparkSession, root: str, version: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).option("multiLine", True).json(f"{root}/{version}/{name}.json")


def sensor_poses(spark: SparkSession, root: str, version: str) -> DataFrame:
    """sample_data with channel, modality, camera_intrinsic and the sensor's pose in the global frame, g00 to g23
    (every sensor at its own time)."""
    data = table(spark, root, version, "sample_data")
    calibrated = table(spark, root, version, "calibrated_sensor").select(F.col("token").alias("calibrated_sensor_token"), "sensor_token", F.col("translation").alias("ct"), F.col("rotation").alias("cq"), "camera_intrinsic")
    sensor = table(spark, root, version, "sensor").select(F.col("token").alias("sensor_token"), "channel", "modality")
    ego = table(spark, root, version, "ego_pose").select(F.col("token").alias("ego_pose_token"), F.col("translation").alias("et"), F.col("rotation").alias("eq"))
    both = data.join(calibrated, "calibrated_sensor_token").join(sensor, "sensor_token").join(ego, "ego_pose_token")
    both = rigid.chain(with_exprs(both, rigid.of_pose("_e", "eq", "et") | rigid.of_pose("_c", "cq", "ct")), "g", "_e", "_c")
    return both.drop("ct", "cq", "et", "eq", *rigid.names("_e"), *rigid.names("_c"))


def cameras(spark: SparkSession, root: str, version: str) -> DataFrame:
    """sample_token, channel, img_w, img_h, fx, skew, cx0, fy, cy0 and e00 to e23 of every camera's key frame: from the
    lidar, at the lidar's time, over the global frame to the camera, at the camera's own time."""
    poses = sensor_poses(spark, root, version).filter("is_key_frame")
    lidar = poses.filter("channel = 'LIDAR_TOP'").select("sample_token", *[F.col(f"g{c[1:]}").alias(c) for c in rigid.names("l")])
    both = rigid.chain(poses.filter("modality = 'camera'").join(lidar, "sample_token"), "e", "-g", "l")
    k = lambda i, j: F.col("camera_intrinsic")[i][j]
    inner = {"fx": k(0, 0), "skew": k(0, 1), "cx0": k(0, 2), "fy": k(1, 1), "cy0": k(1, 2)}
    return both.select("sample_token", "channel", F.col("width").alias("img_w"), F.col("height").alias("img_h"), *[v.alias(n) for n, v in inner.items()], *rigid.names("e"))


def sweeps(spark: SparkSession, root: str, version: str, n: int) -> DataFrame:
    """(key, sweep, back, dt, t00 to t23, sample_token, filename): the n latest lidar sweeps up to every key frame, key frames
    or not, with their transforms into it. A scene's first frames have fewer."""
    lidar = saved(sensor_poses(spark, root, version).filter("channel = 'LIDAR_TOP'"))
    steps = chains.latest(lidar.filter("is_key_frame"), chains.ranked(lidar), n)
    out = chains.sweep_poses(steps, lidar).join(lidar.select(F.col("token").alias("key"), "sample_token"), "key")
    return out.join(lidar.select(F.col("token").alias("sweep"), "filename"), "sweep")


def sweep_points(spark: SparkSession, root: str, version: str, n: int) -> DataFrame:
    """sample_token, back, pt_idx, x, y, z, intensity, ring, dt: the points of the n latest sweeps in the key frame's frame."""
    names = ("x", "y", "z", "intensity", "ring")
    files = [binary_points(spark, f"{root}/{folder}/LIDAR_TOP", names, "*.bin") for folder in (["samples"] if n == 1 else ["samples", "sweeps"])]
    points = reduce(DataFrame.unionByName, files).withColumnRenamed("frame_id", "stem")
    which = sweeps(spark, root, version, n).withColumn("stem", F.regexp_extract("filename", r"([^/]+)\.[a-z]+$", 1))
    both = with_exprs(points.join(which, "stem"), rigid.moved("t"))
    return both.select("sample_token", "back", "pt_idx", *names, "dt")


def annotations(spark: SparkSession, root: str, version: str, classes: dict[str, str] | None = None) -> DataFrame:
    """sample_token, token, class and the box in the frame of the sample's key-frame lidar. Categories outside
    classes are dropped; (w, l, h) becomes (l, w, h); yaw is that of the box's turned x axis."""
    names = F.create_map(*[F.lit(x) for kv in (classes or DETECTION).items() for x in kv])
    category = table(spark, root, version, "category").select(F.col("token").alias("category_token"), F.try_element_at(names, "name").alias("class")).filter("class is not null")
    instance = table(spark, root, version, "instance").select(F.col("token").alias("instance_token"), "category_token")
    lidar = sensor_poses(spark, root, version).filter("is_key_frame and channel = 'LIDAR_TOP'").select("sample_token", *[f"g{i}{j}" for i in range(3) for j in range(4)])
    rows = table(spark, root, version, "sample_annotation").join(instance, "instance_token").join(category, "category_token").join(lidar, "sample_token")
    rows = chains.boxes_in(rows)
    return rows.select("sample_token", "token", "class", "cx", "cy", "cz", "l", "w", "h", "yaw", "num_lidar_pts")


def frames(spark: SparkSession, root: str, version: str, scenes: list[str] | None = None) -> DataFrame:
    """scene, sample_token, timestamp and frame, the sample's place in its scene's chain (by the samples' own links, not by
    their times; samples that the chain does not reach follow it in time order). scenes: names to keep (all by default)."""
    scene = table(spark, root, version, "scene").select(F.col("token").alias("scene_token"), F.col("name").alias("scene"), F.col("first_sample_token").alias("head"))
    if scenes is not None:
        scene = scene.filter(F.col("scene").isin(scenes))
    sample = table(spark, root, version, "sample")
    placed = chains.ranked(sample).join(scene.select("head"), "head", "left_semi").select("token", "position")
    rows = sample.join(scene.drop("head"), "scene_token").join(placed, "token", "left")
    place = F.row_number().over(Window.partitionBy("scene").orderBy(F.asc_nulls_last("position"), "timestamp", "token")) - 1  # a scene has some forty samples
    return rows.select("scene", F.col("token").alias("sample_token"), "timestamp", place.alias("frame"))


def lidar(spark: SparkSession, root: str) -> DataFrame:
    return binary_points(spark, f"{root}/samples/LIDAR_TOP", ("x", "y", "z", "intensity", "ring"), "*.bin")
