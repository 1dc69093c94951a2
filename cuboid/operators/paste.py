"""Copy-paste of objects with their points: a bounded bank of objects, and frames that get what they lack from it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuboid.functions import geom
from cuboid.operators import augment, pairs
from cuboid.operators.order import BUCKET, numbered
from cuboid.plans.tables import saved


class Bank(NamedTuple):
    """Objects to paste. entries: box_idx (unique), label, box columns, n_points; points: obj (an entry's box_idx), pt_idx (in
    the frame it comes from), x, y, z and other columns of points. points is None where frames have cameras only."""

    entries: DataFrame
    points: DataFrame | None


def object_bank(boxes: DataFrame, points: DataFrame | None, min_points: int = 5, size: int | None = None, newest: Sequence[str] = ("frame_id", "box_idx")) -> Bank:
    """The objects of frames: every point belongs to the lowest box that holds it, and boxes with at least min_points points
    are kept; of each class only the newest size ones by the columns of newest (the cap is the feature). Without points
    every labelled box is kept.

    boxes: frame_id, box_idx (unique over all frames), label, box columns; points: frame_id, pt_idx (unique in its frame), x,
    y, z, ... Points are read once, and what lies in boxes is kept with all its columns."""
    if min_points < 1:
        raise ValueError("an object has one point at least")
    if size is not None and size < 1:
        raise ValueError("a bank holds one object of a class at least")
    entries = boxes.filter("label IS NOT NULL")
    owner = None
    if points is None:
        entries = entries.withColumn("n_points", F.lit(0).cast("long"))
    else:
        whole = F.struct(*[c for c in points.columns if c not in ("frame_id", "pt_idx")]).alias("_point")
        inside = pairs.points_in_boxes(points.select("frame_id", "pt_idx", "x", "y", "z", whole), boxes)
        owner = saved(inside.groupBy("frame_id", "pt_idx").agg(F.min("box_idx").alias("box_idx"), F.first("_point").alias("_point")))
        full = owner.groupBy("box_idx").agg(F.count("*").alias("n_points")).filter(F.col("n_points") >= min_points)
        entries = entries.join(full, "box_idx")
    if size is not None:
        late = F.row_number().over(Window.partitionBy("label").orderBy(*[F.desc(c) for c in newest]))
        entries = entries.withColumn("_k", late).filter(F.col("_k") <= size).drop("_k")
    entries = saved(entries.select("box_idx", "frame_id", "label", *geom.BOX, "n_points"))
    if owner is None:
        return Bank(entries, None)
    held = owner.join(entries.select("box_idx"), "box_idx", "left_semi")
    return Bank(entries, held.select("pt_idx", F.col("box_idx").alias("obj"), "_point.*"))


def paste(
    boxes: DataFrame, points: DataFrame | None, bank: Bank, targets: dict[int, int], seed: int = 0, p: float = 1.0,
    reach: tuple[float, float, float] | None = None, std: float | None = None, attempts: int = 0,
) -> tuple[DataFrame, DataFrame | None]:
    """boxes and points of the frames after pasting: frames that a coin of p chooses get, class after class in the order of
    targets, as many objects of the bank as they lack (augment.placed). Scene points inside pasted boxes go, the objects'
    points come after the ones that stay, moved with their boxes; both tables are numbered anew, box_idx and pt_idx from 0
    in every frame. source is the pasted entry's box_idx, null for what was there before.

    Points are read three times (save what is costly to work out). Those that go are kept as lists by bucket of pt_idx (of at
    most BUCKET), so that leaving them out and numbering the rest takes one shuffle of the points.

    Frames without boxes lack nothing (they are not in boxes). A bank without points pastes boxes alone and removes the
    scene points inside them all the same; pasting into frames without points (points None) leaves the objects' points out.
    Objects of other frames and of the frame itself are candidates; the latter meet themselves and drop out."""
    if not 0 <= p <= 1:
        raise ValueError("p lies within 0 and 1")
    chosen = boxes if p == 1 else boxes.filter(F.expr(f"{geom.uniform(seed, 'pasted', 'frame_id')} < {p!r}"))
    stock = bank.entries.select("box_idx", "label", *geom.BOX)
    new = saved(augment.placed(chosen, stock, targets, seed, reach, std, attempts).withColumnRenamed("box_idx", "source"))
    part = lambda df, k, c: df.withColumns({"_part": F.lit(k), "_c": F.col("rank.c") if k else F.lit(0), "_k": F.col("rank.k") if k else F.lit(0).cast("long"), "_at": F.col(c).cast("long")})

    own = ["frame_id", "label", *geom.BOX]
    both = part(boxes.select(*own, "box_idx", F.lit(None).cast("long").alias("source")), 0, "box_idx")
    both = both.unionByName(part(new.select(*own, F.col("source").alias("box_idx"), "source", "rank"), 1, "source").drop("rank"))
    out = numbered(both.drop("box_idx"), ["frame_id"], F.struct("_part", F.when(F.col("_part") == 0, F.floor(F.col("_at") / BUCKET)).otherwise(F.col("_c")).alias("_b")), ["_k", "_at"], "box_idx")
    out = out.drop("_part", "_c", "_k", "_at")
    if points is None:
        return out, None

    block = F.floor(F.col("pt_idx") / BUCKET)
    inside = pairs.points_in_boxes(points.select("frame_id", "pt_idx", "x", "y", "z"), new.select("frame_id", "source", *geom.BOX))
    gone = saved(inside.groupBy("frame_id", block.alias("_bucket")).agg(F.collect_set("pt_idx").alias("_gone")))
    leave = lambda df: df.withColumn("_bucket", block).join(gone, ["frame_id", "_bucket"], "left").filter(~F.coalesce(F.array_contains("_gone", F.col("pt_idx")), F.lit(False))).drop("_gone")
    sizes = saved(leave(points.select("frame_id", "pt_idx")).groupBy("frame_id", "_bucket").agg(F.count("*").alias("_size")))
    stay = leave(points).withColumn("source", F.lit(None).cast("long")).withColumnRenamed("pt_idx", "_at")
    stay = numbered(stay, ["frame_id"], F.col("_bucket"), ["_at"], "pt_idx", sizes).drop("_at")
    if bank.points is not None:
        moved = bank.points.join(new.select("frame_id", F.col("source").alias("obj"), "rank", "dx", "dy", "dz"), "obj")
        moved = moved.withColumns({c: F.col(c) + F.col(f"d{c}") for c in "xyz"}).withColumnRenamed("obj", "source")
        moved = numbered(moved.withColumnRenamed("pt_idx", "_at"), ["frame_id"], F.struct("rank", F.floor(F.col("_at") / BUCKET).alias("_b")), ["_at"], "pt_idx")
        before = sizes.groupBy("frame_id").agg(F.sum("_size").alias("_before"))
        moved = moved.join(before, "frame_id", "left").withColumn("pt_idx", F.col("pt_idx") + F.coalesce("_before", F.lit(0)))
        stay = stay.unionByName(moved.drop("_at", "rank", "dx", "dy", "dz", "_before"), allowMissingColumns=True)
    return out, stay
