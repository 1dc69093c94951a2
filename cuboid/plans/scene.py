"""A 3D scene derived from the given tables: boxes and detections from embeddings, points from lineitem.

Frames have about 25 boxes at every size, so that pairs within frames grow with the data and not with its square."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PI = "3.141592653589793"


def _views(first: int, frames: str) -> dict[str, str]:
    """SQL of the scene's views; first: the index of an array's first element (0 in Spark, 1 in DuckDB); frames: how many
    frames there are."""
    e = lambda k: f"cast(embedding[{k - 1 + first}] AS double)"
    gt = f"""SELECT vec_id % {frames} AS frame_id, vec_id AS box_idx, label, 80*{e(1)} AS cx, 80*{e(2)} AS cy, 4*{e(3)} AS cz, 3+8*abs({e(4)}) AS l,
      1.5+4*abs({e(5)}) AS w, 1.5+4*abs({e(6)}) AS h, 2*{PI}*{e(7)} AS yaw, {e(8)} AS pitch, {e(9)} AS roll, 20*{e(10)} AS vx, 20*{e(11)} AS vy,
      vec_id % 5 - 1 AS attr FROM embeddings"""
    shared = "20*{a}+4*{b}"
    pred = f"""SELECT vec_id % {frames} AS frame_id, vec_id AS det_idx, CASE WHEN vec_id % 7 = 0 THEN (label+1) % 10 ELSE label END AS label,
      80*{e(1)}+6*{e(12)} AS cx, 80*{e(2)}+6*{e(13)} AS cy, 4*{e(3)}+0.5*{e(14)} AS cz, (3+8*abs({e(4)}))*(1+0.3*{e(15)}) AS l,
      (1.5+4*abs({e(5)}))*(1+0.3*{e(15)}) AS w, (1.5+4*abs({e(6)}))*(1+0.3*{e(15)}) AS h, 2*{PI}*{e(7)}+0.5*{e(16)} AS yaw, {e(8)} AS pitch, {e(9)} AS roll,
      0.5+0.9*{e(17)} AS score, {shared.format(a=e(10), b=e(18))} AS vx, {shared.format(a=e(11), b=e(19))} AS vy, vec_id % 5 - 1 AS attr
      FROM embeddings WHERE vec_id % 5 <> 0
      UNION ALL SELECT vec_id % {frames}, vec_id + 1000000000, label, -80*{e(1)}, -80*{e(2)}, 4*{e(3)}, 3+8*abs({e(4)}), 1.5+4*abs({e(5)}), 1.5+4*abs({e(6)}), 2*{PI}*{e(7)},
      {e(8)}, {e(9)}, 0.2+0.3*abs({e(20)}), 20*{e(10)}, 20*{e(11)}, vec_id % 5 - 1 FROM embeddings WHERE vec_id % 9 = 0"""
    points = f"""SELECT l_orderkey % {frames} AS frame_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice-80*floor(l_extendedprice/80)-40 AS x,
      ((37*l_partkey+11*l_orderkey+101*l_suppkey) % 8000)/100.0-40 AS y, l_quantity/25-1 AS z, l_discount AS f0, l_tax AS f1 FROM lineitem"""
    cams = f"""SELECT n_nationkey AS cam_idx, 2*{PI}*n_nationkey/6 AS cam_yaw, 500.0 AS fx, 0.0 AS skew, 320.0 AS cx0, 500.0 AS fy, 240.0 AS cy0,
      640 AS img_w, 480 AS img_h FROM nation WHERE n_nationkey < 6"""
    sweeps = """SELECT event_id, user_id AS sensor, ts, value AS x, (event_id % 400)/10.0-20 AS y, (event_id % 7)-3.0 AS z FROM events"""
    unit = lambda k: "array(" + ", ".join(f"{e(k + i)}/sqrt(" + "+".join(f"{e(k + n)}*{e(k + n)}" for n in range(4)) + ")" for i in range(4)) + ")"
    at = lambda k, by: f"array({by}*{e(k)}, {by}*{e(k + 1)}, {by}*{e(k + 2)})"
    poses = f"""SELECT vec_id, {unit(1)} AS eq, {at(5, 900.0)} AS et, {unit(8)} AS cq, {at(12, 2.0)} AS ct, {unit(15)} AS eq2, {at(19, 900.0)} AS et2,
      {unit(22)} AS cq2, {at(26, 2.0)} AS ct2, array(1.5+4*abs({e(30)}), 3+8*abs({e(31)}), 1.5+4*abs({e(32)})) AS size, {unit(33)} AS rotation, {at(37, 900.0)} AS translation FROM embeddings"""
    if first:
        poses = poses.replace("array(", "list_value(")
    samples = """SELECT o_orderkey AS token, o_custkey AS scene, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders"""
    drives = """SELECT event_id AS token, user_id AS sensor, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_id % 5 = 0 AS is_key_frame,
      1000000 + 50000*event_id AS timestamp, value AS x, (event_id % 400)/10.0-20 AS y, (event_id % 7)-3.0 AS z FROM events"""
    return {"poses": poses, "samples": samples, "drives": drives, "gt": gt, "pred": pred, "points": points, "cams": cams, "sweeps": sweeps}


_TABLES = {"poses": "embeddings", "samples": "orders", "drives": "events", "gt": "embeddings", "pred": "embeddings", "points": "lineitem", "cams": "nation", "sweeps": "events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of gt, pred, points, cams, sweeps, poses, samples and drives."""
    frames = max(20, spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() // 25) if name in ("gt", "pred", "points") else 20
    text = _views(0, str(frames))[name].replace("/100.0", "/100.0D").replace("/10.0-20", "/10.0D-20").replace("500.0", "500.0D").replace("0.0 AS", "0.0D AS").replace("-3.0 AS", "-3.0D AS")
    base = spark.read.parquet(f"{sf_dir}/{_TABLES[name]}.parquet")
    return spark.sql(text.replace(f"FROM {_TABLES[name]}", "FROM {base}"), base=base)


def oracle(sql: str) -> str:
    """sql with the scene's views, for DuckDB."""
    used = [f"{n} AS ({q})" for n, q in _views(1, "(SELECT greatest(20, count(*) // 25) FROM embeddings)").items() if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    return ("WITH " if "WITH RECURSIVE" not in sql else "WITH RECURSIVE ") + ", ".join(used) + (", " + sql.strip().removeprefix("WITH RECURSIVE").removeprefix("WITH").strip() if sql.strip().startswith("WITH") else " " + sql)
