"""Linked lists (rows that name the one before them) and what is read along them: positions, the latest sweeps, poses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.functions import rigid
from cuboid.operators.boxes import with_exprs
from cuboid.plans.tables import drop, saved


def ranked(rows: DataFrame, token: str = "token", prev: str = "prev") -> DataFrame:
    """A saved table (token, head, position): the first row of each row's list, and its distance from it.

    Pointers double: in every round a row takes over the pointer of the row that its own points at, so a list of n rows
    takes log n joins on tokens, however the rows are spread over lists. A list begins where prev is null, empty or names no
    row. Tokens are unique; a list that runs in a circle is refused."""
    links = rows.select(F.col(token).alias("token"), F.when(F.col(prev).cast("string") != "", F.col(prev)).alias("prev"))
    here = links.select(F.col("token").alias("prev"), F.lit(True).alias("_is"))
    state = links.join(here, "prev", "left")
    state = saved(state.select("token", F.when(F.col("_is"), F.col("prev")).otherwise(F.col("token")).alias("to"), F.when(F.col("_is"), 1).otherwise(0).cast("long").alias("far"), F.col("_is").isNull().alias("done")))
    rounds = max(state.count(), 2).bit_length() + 1
    while state.filter("NOT done").take(1):
        if not rounds:
            drop(state)
            raise ValueError("a list runs in a circle")
        rounds -= 1
        ahead = state.select(F.col("token").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("done").alias("_done"))
        further = state.filter("NOT done").join(ahead, "to").select("token", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far"), F.col("_done").alias("done"))
        state = saved(state.filter("done").unionByName(further), state)
    out = state.select("token", F.col("to").alias("head"), F.col("far").alias("position"))
    out.saved_at = state.saved_at
    return out


def latest(keys: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """(key, sweep, back): for every token of keys (token) the n latest rows of its list up to it, itself first (back 0),
    fewer at a list's start. ranks: see ranked()."""
    if n < 1:
        raise ValueError("a frame has one sweep at least")
    wanted = keys.select("token").join(ranks, "token").withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    wanted = wanted.select(F.col("token").alias("key"), "head", (F.col("position") - F.col("back")).alias("position"), "back")
    return wanted.join(ranks.withColumnRenamed("token", "sweep"), ["head", "position"]).select("key", "sweep", "back")


def sweep_poses(steps: DataFrame, poses: DataFrame) -> DataFrame:
    """(key, sweep, back, dt, t00 to t23): each sweep's transform into the key sweep's frame, through the global frame at
    either time, and how many seconds older it is. steps: key, sweep, back; poses: token, timestamp (microseconds) and
    g00 to g23, the sensor's pose in the global frame when the row was taken."""
    pose = poses.select("token", "timestamp", *rigid.names("g"))
    own = pose.select(F.col("token").alias("sweep"), F.col("timestamp").alias("_t"), *[F.col(f"g{c[1:]}").alias(f"s{c[1:]}") for c in rigid.names("s")])
    both = steps.join(own, "sweep").join(pose.withColumnRenamed("token", "key"), "key")
    both = rigid.chain(both, "t", "-g", "s").withColumn("dt", (F.col("timestamp") - F.col("_t")) / 1e6)
    return both.select("key", "sweep", "back", "dt", *rigid.names("t"))


def boxes_in(boxes: DataFrame, pose: str = "g") -> DataFrame:
    """Boxes given in the outer frame (translation, rotation arrays; size as w, l, h) in the frame of the pose columns: centre,
    l, w, h, and the yaw of the box's own x axis, seen from there."""
    turn = rigid.quaternion("rotation")
    df = with_exprs(boxes, rigid.inverse("_i", pose) | {f"_x{i}": turn[f"{i}0"] for i in range(3)})
    centre = {n: "+".join(f"_i{i}{k}*translation[{k}]" for k in range(3)) + f"+_i{i}3" for i, n in enumerate(("cx", "cy", "cz"))}
    ahead = [f"({'+'.join(f'_i{i}{k}*_x{k}' for k in range(3))})" for i in range(2)]
    df = with_exprs(df, centre | {"l": "size[1]", "w": "size[0]", "h": "size[2]", "yaw": f"atan2({ahead[1]}, {ahead[0]})"})
    return df.drop(*rigid.names("_i"), *[f"_x{i}" for i in range(3)])
