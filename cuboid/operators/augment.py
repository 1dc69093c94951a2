"""Augmentations that depend on a seed and on row values only, so they agree in any partitioning; and copy-paste."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuboid.functions.geom import uniform
from cuboid.operators import pairs
from cuboid.operators.boxes import with_exprs
from cuboid.operators.greedy import suppress
from cuboid.operators.order import BUCKET, hash_bucket, numbered
from cuboid.plans.tables import saved

#: Names of the image transforms that are refused.
REFUSED = (
    "ElasticTransform", "RandomPerspective", "RandomAffine", "RandomRotation", "FiveCrop", "TenCrop", "RandomIoUCrop", "AugMix",
    "AutoAugment", "RandAugment", "TrivialAugmentWide", "CutMix", "MixUp",
)


def refuse(name: str) -> None:
    """Raises TypeError for image transforms that have no meaning for 3D scenes."""
    if name in REFUSED:
        raise TypeError(f"{name} does not apply to 3D scenes")


def shuffle_points(points: DataFrame, key: list[str], seed: int = 0, which: Column | None = None) -> DataFrame:
    """points with pt_idx, a random order within the frame (ties by key), without sorting a frame in one task. which: the
    frames to shuffle; others keep the order of their pt_idx."""
    return _mixed(points, key, seed, which).drop("_n")


def _mixed(points: DataFrame, key: list[str], seed: int, which: Column | None = None) -> DataFrame:
    """shuffle_points with _n, the size of the frame. Points are worked out once and saved: they are counted twice before they
    are numbered."""
    u = F.expr(uniform(seed, "shuffle", "frame_id", *key))
    rows, bucket = hash_bucket(saved(points.withColumn("_u", u)), ["frame_id"], F.col("_u"))
    if which is None:
        return numbered(rows, ["frame_id"], bucket, ["_u", *key], "pt_idx").drop("_u")
    rows = rows.withColumn("_go", which)
    mixed = F.when(F.col("_go"), bucket).otherwise(F.floor(F.col("pt_idx") / BUCKET))
    return numbered(rows, ["frame_id"], mixed, [F.when(F.col("_go"), F.col("_u")), *key], "pt_idx").drop("_u", "_go")


def sample_points(points: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n points of every frame, numbered by slot: without replacement where it has as many, with replacement otherwise.

    A small frame's slots are dealt to its points in turn, so that many tasks make them, and meet the points that they draw in
    a shuffle at every size; a row of frames makes n slots, too many to broadcast."""
    first = saved(_mixed(points, key, seed).filter(F.col("pt_idx") < n))
    whole = first.filter(F.col("_n") >= n).withColumn("slot", F.col("pt_idx").cast("int"))
    few = first.filter(F.col("_n") < n)
    slots = few.select("frame_id", "_n", F.explode(F.sequence(F.col("pt_idx"), F.lit(n - 1).cast("long"), F.col("_n"))).alias("slot"))
    slots = slots.withColumn("slot", F.col("slot").cast("int")).withColumn("pt_idx", F.floor(F.expr(uniform(seed, "draw", "frame_id", "slot")) * F.col("_n"))).drop("_n")
    return whole.unionByName(few.hint("merge").join(slots, ["frame_id", "pt_idx"])).drop("_n")


def jitter_points(points: DataFrame, sigma: float, key: list[str], seed: int = 0) -> DataFrame:
    """Normal noise on x, y and z (Box-Muller on two hashes)."""
    noise = lambda c: f"{c}+({sigma!r})*sqrt(-2*ln(1-{uniform(seed, c + '1', 'frame_id', *key)}))*cos(2*pi()*{uniform(seed, c + '2', 'frame_id', *key)})"
    return with_exprs(points, {c: noise(c) for c in "xyz"})


def random_flip(df: DataFrame, axis: str, p: float, exprs: dict[str, str], seed: int = 0, has_cameras: bool = False) -> DataFrame:
    """df mirrored in a share p of the frames. Scenes with cameras are refused, even where no frame would flip."""
    if has_cameras:
        raise TypeError("a mirrored scene does not fit its camera images")
    if not 0 <= p <= 1:
        raise ValueError("p lies within 0 and 1")
    u = uniform(seed, f"flip{axis}", "frame_id")
    return with_exprs(df, {k: f"CASE WHEN {u} < {p!r} THEN {v} ELSE {k} END" for k, v in exprs.items() if k != v})


def random_translate(df: DataFrame, reach: tuple[float, float, float], names: tuple[str, str, str], seed: int = 0) -> DataFrame:
    """df moved by a uniform offset a frame."""
    return with_exprs(df, {n: f"{n}+({r!r})*(2*{uniform(seed, f'move{i}', 'frame_id')}-1)" for i, (n, r) in enumerate(zip(names, reach, strict=True))})


def random_scale(df: DataFrame, low: float, high: float, names: tuple[str, ...], seed: int = 0) -> DataFrame:
    """df scaled by a uniform factor a frame."""
    if not 0 < low <= high:
        raise ValueError("scales are positive and ordered")
    return with_exprs(df, {n: f"{n}*({low!r}+({high - low!r})*{uniform(seed, 'scale', 'frame_id')})" for n in names})


def random_rotate_z(df: DataFrame, reach: float, names: tuple[str, str], seed: int = 0, yaw: str | None = None) -> DataFrame:
    """df turned about z by a uniform angle a frame, within reach to either side."""
    a = f"(({reach!r})*(2*{uniform(seed, 'turn', 'frame_id')}-1))"
    x, y = names
    return with_exprs(df, {x: f"cos({a})*{x}-sin({a})*{y}", y: f"sin({a})*{x}+cos({a})*{y}"} | ({yaw: f"{yaw}+{a}"} if yaw else {}))


def deficit(boxes: DataFrame, targets: dict[int, int]) -> DataFrame:
    """(frame_id, label, missing): how many boxes of each class a frame lacks."""
    frames = boxes.select("frame_id").distinct()
    want = F.map_from_arrays(F.array(*map(F.lit, targets)), F.array(*map(F.lit, targets.values())))
    have = boxes.groupBy("frame_id", "label").agg(F.count("*").alias("have"))
    rows = frames.select("frame_id", F.explode(want).alias("label", "target")).join(have, ["frame_id", "label"], "left")
    return rows.select("frame_id", "label", F.greatest(F.col("target") - F.coalesce("have", F.lit(0)), F.lit(0)).cast("long").alias("missing"))


def truncated_normal(u: Column, low: float, high: float, std: float) -> Column:
    """Numbers of a normal distribution about 0 cut off at low and high, from uniform ones, by its inverse."""
    if std <= 0 or low > high:
        raise ValueError("std is positive and the range is ordered")
    bell = NormalDist(0.0, std)
    a, b = bell.cdf(low), bell.cdf(high)

    @F.pandas_udf("double")
    def inverse(x: pd.Series) -> pd.Series:
        if low == high:
            return x * 0 + low
        return x.map(lambda v: min(max(bell.inv_cdf(min(max(a + v * (b - a), 1e-300), 1 - 1e-16)), low), high))

    return inverse(u)


_STEPS = (10007, 20011, 30011, 40009, 50021, 60013, 70001, 80021, 90001, 100003)  # primes


def offered(need: DataFrame, stock: DataFrame, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """Rows of need (frame_id, label, missing) with the boxes of stock (box_idx, label) that they are offered, numbered
    by _k from 1: missing different ones of the class, all of it where it has fewer.

    A class is numbered in a random order, by hashed buckets; a frame takes numbers from a random start in steps that
    are prime to the size of the class, so that it meets the boxes it takes and no others."""
    u = F.expr(uniform(seed, "stock", "box_idx"))
    rows = stock.drop("frame_id").withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets))
    sizes = rows.groupBy("label", "_b").agg(F.count("*").alias("_m"))
    mine = Window.partitionBy("label")
    sizes = sizes.withColumns({"_n": F.sum("_m").over(mine), "_before": F.sum("_m").over(mine.orderBy("_b")) - F.col("_m")}).drop("_m")
    at = F.row_number().over(Window.partitionBy("label", "_b").orderBy("_u", "box_idx")) - 1
    rows = rows.withColumn("_at", at).join(sizes.drop("_n"), ["label", "_b"]).withColumn("_at", F.col("_at") + F.col("_before")).drop("_u", "_b", "_before")
    need = need.join(sizes.select("label", "_n").distinct(), "label")
    step = F.array(*map(F.lit, _STEPS))[F.floor(F.expr(uniform(seed, "step", "frame_id", "label")) * len(_STEPS)).cast("int")]
    step = F.when(F.col("_n") % step == 0, 1).otherwise(step)
    start = F.floor(F.expr(uniform(seed, "paste", "frame_id", "label")) * F.col("_n"))
    slots = need.withColumns({"_start": start, "_step": step}).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least("missing", "_n"))))
    slots = slots.withColumn("_at", (F.col("_start") + F.col("_k") * F.col("_step")) % F.col("_n")).drop("_n", "_start", "_step")
    return slots.join(rows, ["label", "_at"]).drop("_at")


def placed(boxes: DataFrame, stock: DataFrame, targets: dict[int, int], seed: int = 0, reach: tuple[float, float, float] | None = None, std: float | None = None, attempts: int = 0) -> DataFrame:
    """Boxes of stock (box_idx, label, box columns) to paste into frames, with their offsets dx, dy and dz and their order
    in the frame, rank (c, k): for every class the first missing ones of a random order, kept in that order if they meet
    no box of the frame and none kept before (classes in the order of targets). Candidates that collide are not replaced.

    With attempts, a candidate tries so many random offsets within reach (uniform, or truncated normal with std) and
    at last none; the first free one counts. A try is a node of one greedy order: it is suppressed by colliding tries
    of better candidates that are kept, and by an earlier try of its own candidate."""
    need = deficit(boxes, targets).filter("missing > 0")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(targets) for x in (k, i)])
    ranked = offered(need, stock, seed)
    ranked = ranked.withColumn("rank", F.struct(order[F.col("label")].alias("c"), F.col("_k").alias("k"))).drop("_k", "missing")
    ranked = ranked.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(attempts))))
    for n, r in zip(("cx", "cy", "cz"), reach or (0.0,) * 3, strict=True):
        v = F.lit(0.0)
        if attempts and reach is not None:
            u = F.expr(uniform(seed, f"offset{n}", "frame_id", "box_idx", "try"))
            v = F.when(F.col("try") < attempts, (2 * u - 1) * r if std is None else truncated_normal(u, -r, r, std)).otherwise(0.0)
        ranked = ranked.withColumn(f"d{n[1]}", v).withColumn(n, F.col(n) + F.col(f"d{n[1]}"))
    hit = pairs.overlapping(ranked, boxes).select("frame_id", F.col("a_box_idx").alias("box_idx"), F.col("a_try").alias("try")).distinct()
    free = saved(ranked.join(hit, ["frame_id", "box_idx", "try"], "left_anti").withColumn("id", F.concat_ws("|", "frame_id", "box_idx", "try")))
    both = pairs.overlapping(free, free).filter("a_rank < b_rank").select(F.col("a_id").alias("better"), F.col("b_id").alias("worse"))
    own = free.select("frame_id", "box_idx", F.col("try").alias("_t"), F.col("id").alias("better")).join(free.select("frame_id", "box_idx", "try", F.col("id").alias("worse")), ["frame_id", "box_idx"]).filter("_t < try")
    return suppress(free, both.unionByName(own.select("better", "worse"))).drop("id", "try")


def place(boxes: DataFrame, stock: DataFrame, targets: dict[int, int], seed: int = 0, reach: tuple[float, float, float] | None = None, std: float | None = None, attempts: int = 0) -> DataFrame:
    """The boxes of placed() without offsets and order."""
    return placed(boxes, stock, targets, seed, reach, std, attempts).drop("rank", "dx", "dy", "dz")
