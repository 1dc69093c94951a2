"""Queries over linked lists and poses, with SQL that carries points through every frame one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.functions import rigid
from cuboid.operators import chains, sweeps
from cuboid.operators.boxes import with_exprs
from cuboid.plans.registry import query, rounded, rounded_sql
from cuboid.plans.scene import view


def _turned(q: str, v: list[str], back: bool = False) -> list[str]:
    """SQL of a vector turned by a unit quaternion (v + 2 w u x v + 2 u x (u x v)), or turned back."""
    w, *u = (f"{q}[{i}]" for i in range(1, 5))
    u = [f"(-{c})" for c in u] if back else u
    cross = lambda a, b: [f"({a[1]}*{b[2]}-{a[2]}*{b[1]})", f"({a[2]}*{b[0]}-{a[0]}*{b[2]})", f"({a[0]}*{b[1]}-{a[1]}*{b[0]})"]
    once = cross(u, v)
    return [f"({a}+2*{w}*{b}+2*{c})" for a, b, c in zip(v, once, cross(u, once), strict=True)]


def _carried(source: str, steps: list[tuple[str, str, bool]]) -> str:
    """SQL of the points x, y, z of a table carried through poses (quaternion, offset, whether undone), a level each."""
    for q, t, back in steps:
        v = [f"({c}-{t}[{i}])" if back else c for i, c in enumerate("xyz", 1)]
        out = _turned(q, v, back)
        new = ", ".join(f"{e if back else f'{e}+{t}[{i}]'} AS {c}" for i, (c, e) in enumerate(zip("xyz", out, strict=True), 1))
        source = f"(SELECT * REPLACE ({new}) FROM {source})"
    return source


_PROBES = "(SELECT *, p, (p = 1)::INT::DOUBLE AS x, (p = 2)::INT::DOUBLE AS y, (p = 3)::INT::DOUBLE AS z FROM poses, range(0, 4) r(p))"
_ENDS = _carried(_PROBES, [("cq", "ct", False), ("eq", "et", False), ("eq2", "et2", True), ("cq2", "ct2", True)])


def _cell(i: int, j: int) -> str:
    c, origin = "xyz"[i], f"max({'xyz'[i]}) FILTER (p = 0)"
    return origin if j == 3 else f"max({c}) FILTER (p = {j + 1}) - {origin}"


@query(f"SELECT vec_id, {rounded_sql(' '.join(rigid.names('e')), **{f'e{i}{j}': _cell(i, j) for i in range(3) for j in range(4)})} FROM {_ENDS} GROUP BY vec_id")
def pose_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from one sensor to another through their mounts and the vehicle's poses at both times, as one transform."""
    p = view(spark, sf_dir, "poses")
    p = with_exprs(p, rigid.of_pose("a", "cq", "ct") | rigid.of_pose("b", "eq", "et") | rigid.of_pose("c", "eq2", "et2") | rigid.of_pose("d", "cq2", "ct2"))
    return rounded(rigid.chain(p, "e", "-d", "-c", "b", "a").select("vec_id", *rigid.names("e")))


_CENTRE = _carried("(SELECT *, translation[1] AS x, translation[2] AS y, translation[3] AS z FROM poses)", [("eq", "et", True), ("cq", "ct", True)])
_AHEAD = f"(SELECT vec_id, eq, cq, {', '.join(f'{v} AS {c}' for c, v in zip('xyz', _turned('rotation', ['1.0', '0.0', '0.0']), strict=True))} FROM poses)"
for _q in ("eq", "cq"):
    _AHEAD = f"(SELECT * REPLACE ({', '.join(f'{v} AS {c}' for c, v in zip('xyz', _turned(_q, list('xyz'), True), strict=True))}) FROM {_AHEAD})"


@query(f"SELECT c.vec_id, {rounded_sql('cx cy cz l w h yaw', cx='c.x', cy='c.y', cz='c.z', l='size[2]', w='size[1]', h='size[3]', yaw='atan2(a.y, a.x)')} FROM {_CENTRE} c JOIN {_AHEAD} a ON a.vec_id = c.vec_id")
def annotation_to_lidar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the global frame, seen from a sensor on a vehicle."""
    p = view(spark, sf_dir, "poses")
    p = rigid.chain(with_exprs(p, rigid.of_pose("a", "eq", "et") | rigid.of_pose("b", "cq", "ct")), "g", "a", "b")
    return rounded(chains.boxes_in(p).select("vec_id", "cx", "cy", "cz", "l", "w", "h", "yaw"))


@query("SELECT token, (row_number() OVER w - 1)::BIGINT AS position, first_value(token) OVER w AS head FROM samples JOIN orders ON o_orderkey = token WINDOW w AS (PARTITION BY scene ORDER BY o_orderdate, o_orderkey)")
def sample_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample's place in its scene and the scene's first sample, from the samples' links alone."""
    return chains.ranked(view(spark, sf_dir, "samples")).select("token", "position", "head")


def _drive_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of drives with the sensor's pose in the global frame: a vehicle that turns as it goes, a tilted mount."""
    d = view(spark, sf_dir, "drives")
    a, b = "(0.001D*(token % 5000))", "(0.05D*(sensor % 10))"
    d = d.withColumns({"eq": F.expr(f"array(cos({a}), 0.0D, 0.0D, sin({a}))"), "et": F.expr("array(0.5D*(token % 900), 0.25D*(token % 700), 0.0D)"), "cq": F.expr(f"array(cos({b}), sin({b}), 0.0D, 0.0D)"), "ct": F.expr("array(1.0D, 0.0D, 1.8D)")})
    return rigid.chain(with_exprs(d, rigid.of_pose("a", "eq", "et") | rigid.of_pose("b", "cq", "ct")), "g", "a", "b")


_DRIVE = """SELECT *, list_value(cos(0.001*(token % 5000)), 0.0, 0.0, sin(0.001*(token % 5000))) AS eq, list_value(0.5*(token % 900), 0.25*(token % 700), 0.0) AS et,
list_value(cos(0.05*(sensor % 10)), sin(0.05*(sensor % 10)), 0.0, 0.0) AS cq, list_value(1.0, 0.0, 1.8) AS ct, row_number() OVER (PARTITION BY sensor ORDER BY ts, event_id) AS k FROM drives JOIN events ON event_id = token"""
_GATHERED = _carried(
    "(SELECT f.token AS frame, s.token AS sweep, (f.k - s.k)::INT AS back, (f.timestamp - s.timestamp)/1e6 AS dt, s.x, s.y, s.z, s.eq, s.et, s.cq, s.ct, f.eq AS eq2, f.et AS et2, f.cq AS cq2, f.ct AS ct2 FROM d f JOIN d s ON s.sensor = f.sensor AND s.k <= f.k AND f.k - s.k < 4 WHERE f.is_key_frame)",
    [("cq", "ct", False), ("eq", "et", False), ("eq2", "et2", True), ("cq2", "ct2", True)],
)


@query(f"WITH d AS ({_DRIVE}) SELECT frame, sweep, back, {rounded_sql('dt x y z')} FROM {_GATHERED}")
def multi_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the four latest sweeps up to every key frame, by the sweeps' links, in the key frame's frame."""
    drives = _drive_poses(spark, sf_dir)
    steps = chains.latest(drives.filter("is_key_frame"), chains.ranked(drives), 4)
    poses = chains.sweep_poses(steps, drives)
    points = drives.select(F.col("token").alias("sweep"), "x", "y", "z")
    return rounded(sweeps.accumulate(points, poses).select(F.col("key").alias("frame"), "sweep", "back", "dt", "x", "y", "z"))
