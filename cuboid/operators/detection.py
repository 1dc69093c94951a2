"""Detection metrics: greedy matching and average precision, as joins and aggregations.

Running counts over a class are taken in ranges of scores first, so that a class with a large share of all detections
needs no window over all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuboid.operators import greedy, pairs
from cuboid.plans.tables import saved

POINTS = {"r11": 10, "r40": 40, "r101": 100}


def with_bins(df: DataFrame, bins: Sequence[tuple[float, float]]) -> DataFrame:
    """A row per bin [low, high) that holds a box's distance from the origin; bins may overlap or leave gaps."""
    table = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for i, (a, b) in enumerate(bins)])
    far = F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2 + F.col("cz") ** 2)
    return df.withColumn("_b", F.explode(table)).filter((far >= F.col("_b.low")) & (far < F.col("_b.high"))).withColumn("bin", F.col("_b.bin")).drop("_b")


def nms(pred: DataFrame, least: float, by_class: bool = False, fmt: str = "XYZLWHYPR") -> DataFrame:
    """The detections that greedy suppression keeps in every frame (of each class with by_class): best score first
    (ties: the smaller det_idx), each kept one suppressing those whose IoU with it is over least."""
    both = pairs.iou(pred, pred, ["label"] if by_class else None, fmt).filter(F.col("iou") > least)
    better = F.struct((-F.col("a_score")).alias("s"), "a_det_idx") < F.struct((-F.col("b_score")).alias("s"), F.col("b_det_idx").alias("a_det_idx"))
    edges = both.filter(better).select(F.col("a_det_idx").alias("better"), F.col("b_det_idx").alias("worse"))
    return greedy.suppress(pred.withColumnRenamed("det_idx", "id"), edges).withColumnRenamed("id", "det_idx")


def candidates_by_iou(pred: DataFrame, gt: DataFrame, least: float, fmt: str = "XYZLWHYPR", on: Sequence[str] = ()) -> DataFrame:
    """Pairs of one frame and label (and equal columns of on) with IoU >= least (> 0): det_idx, gt_idx, value (smaller
    is better), score."""
    found = pairs.iou(pred, gt, ["label", *on], fmt).filter(F.col("iou") >= least)
    return found.select("frame_id", "label", *on, F.col("a_det_idx").alias("det_idx"), F.col("b_box_idx").alias("gt_idx"), (-F.col("iou")).alias("value"), F.col("a_score").alias("score"))


def candidates_by_distance(pred: DataFrame, gt: DataFrame, below: float) -> DataFrame:
    """Pairs of one frame and label whose ground distance is under a threshold; cells of that size meet."""
    own = pred.withColumns({"gx": F.floor(F.col("cx") / below), "gy": F.floor(F.col("cy") / below)})
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    wide = gt.withColumn("_s", F.explode(around)).withColumns({"gx": F.floor(F.col("cx") / below) + F.col("_s.i"), "gy": F.floor(F.col("cy") / below) + F.col("_s.j")})
    wide = wide.select("frame_id", "label", "gx", "gy", F.col("box_idx").alias("gt_idx"), F.col("cx").alias("_x"), F.col("cy").alias("_y"))
    both = own.join(wide, ["frame_id", "label", "gx", "gy"]).withColumn("value", F.sqrt((F.col("cx") - F.col("_x")) ** 2 + (F.col("cy") - F.col("_y")) ** 2))
    return both.filter(F.col("value") < below).select("frame_id", "label", "det_idx", "gt_idx", "value", "score")


def match(candidates: DataFrame, later_first: bool = False, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, det_idx, gt_idx): best score first, every detection takes its best ground truth still free, apart for
    each value of groups (one chain of rounds serves all). Ties of the score go to the smaller det_idx, or to the later
    frame and det_idx; ties of the value to the smaller gt_idx."""
    order = F.struct((-F.col("frame_id")).alias("f"), (-F.col("det_idx")).alias("d")) if later_first else F.struct("frame_id", "det_idx")
    side = lambda c: F.struct(*groups, F.col(c).alias("idx"))
    edges = candidates.select(side("det_idx").alias("left"), side("gt_idx").alias("right"), F.struct((-F.col("score")).alias("s"), order.alias("o")).alias("rank"), "value", F.col("gt_idx").alias("tie"))
    return greedy.assign(edges).select(*[F.col(f"left.{g}").alias(g) for g in groups], F.col("left.idx").alias("det_idx"), F.col("right.idx").alias("gt_idx"))


def running_sums(df: DataFrame, keys: list[str], score: str, tie: str, sums: dict[str, Column], rows: int = 1 << 20) -> DataFrame:
    """df with sums of columns over all rows with the same keys up to each row, best score first.

    Rows are cut into ranges of about so many rows by keys, score and tie, as many as the table needs, and every range
    is summed first. So no window holds more than a range, whatever a key's share of the rows and however many scores
    are equal."""
    df = saved(df.withColumns({f"_v_{n}": e for n, e in sums.items()}))
    ranges = df.count() // rows + 1
    if ranges == 1:
        df = df.withColumn("_range", F.lit(0))
    else:  # written, as ranges are drawn anew whenever they are computed
        df = saved(df.repartitionByRange(ranges, *keys, F.desc(score), F.asc(tie)).withColumn("_range", F.spark_partition_id()), df)
    parts = df.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_range", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    within = Window.partitionBy(*keys, "_range").orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(parts, [*keys, "_range"]).withColumns({n: F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(within) for n in sums})
    return out.drop("_range", *[f"_{k}_{n}" for n in sums for k in "vb"])


def running(df: DataFrame, keys: list[str], score: str, tie: str, flag: str, rows: int = 1 << 20) -> DataFrame:
    """df with tp and seen: counts of flagged rows and of all rows with the same keys up to each row, best first."""
    return running_sums(df, keys, score, tie, {"tp": F.col(flag).cast("long"), "seen": F.lit(1).cast("long")}, rows)


def average_precision(curve: DataFrame, totals: DataFrame, keys: list[str], how: str = "r40") -> DataFrame:
    """(keys, num_gt, ap). curve: keys, tp, seen of every detection; totals: keys, num_gt. A key without ground truth
    has AP -1. r11, r40 and r101 sample the precision envelope at k / K recalls (r40 without recall 0); all_points
    integrates it."""
    rows = curve.join(totals, keys).withColumn("p", F.col("tp") / F.col("seen")).filter("num_gt > 0")
    if how == "all_points":
        levels = rows.filter("tp > 0").groupBy(*keys, "num_gt", "tp").agg(F.max("p").alias("p"))
        after = Window.partitionBy(*keys).orderBy("tp").rowsBetween(0, Window.unboundedFollowing)
        found = levels.withColumn("p", F.max("p").over(after)).groupBy(*keys).agg((F.sum("p") / F.max("num_gt")).alias("ap"))
    else:
        k = POINTS[how]
        reach = F.floor(F.col("tp") * k / F.col("num_gt"))
        if how == "r101":  # targets are single-precision numbers here
            up = reach + 1
            reach = F.when((up <= k) & ((F.col("tp") / F.col("num_gt")).cast("float") >= up.cast("float") / 100), up).otherwise(reach)
        best = rows.groupBy(*keys, reach.alias("reach")).agg(F.max("p").alias("p"))
        first = 1 if how == "r40" else 0
        spread = best.withColumn("k", F.explode(F.sequence(F.lit(first), F.greatest(F.col("reach"), F.lit(first))))).filter(F.col("k") <= F.col("reach"))
        found = spread.groupBy(*keys, "k").agg(F.max("p").alias("p")).groupBy(*keys).agg((F.sum("p") / (k + 1 - first)).alias("ap"))
    return totals.join(found, keys, "left").withColumn("ap", F.when(F.col("num_gt") == 0, F.lit(-1.0)).otherwise(F.coalesce("ap", F.lit(0.0))))


def map3d(pred: DataFrame, gt: DataFrame, ious: Sequence[float] = (0.1, 0.3, 0.5), bins: Sequence[tuple[float, float]] = ((0.0, float("inf")),), how: str = "r40", fmt: str = "XYZLWHYPR") -> DataFrame:
    """(label, iou, bin, num_gt, ap) for every combination, and its roll-ups: over all, per class, per IoU, per class
    and IoU, per bin, per class and bin (the columns summed over are null). Means take defined values only; -1 if
    there are none."""
    p, g = (saved(with_bins(x, bins)) for x in (pred, gt))
    levels, keys = F.explode(F.array(*[F.lit(float(i)) for i in ious])), ["label", "bin", "iou"]
    found = candidates_by_iou(p, g, min(ious), fmt, ["bin"]).withColumn("iou", levels).filter(-F.col("value") >= F.col("iou"))
    hits = match(found, groups=["bin", "iou"]).select("bin", "iou", "det_idx", F.lit(True).alias("hit"))
    flagged = p.select("label", "bin", "score", "det_idx").withColumn("iou", levels).join(hits, ["bin", "iou", "det_idx"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    counts = g.groupBy("label", "bin").agg(F.count("*").alias("num_gt"))
    seen = p.select("label", "bin").unionByName(g.select("label", "bin")).distinct().join(counts, ["label", "bin"], "left").na.fill(0).withColumn("iou", levels)
    out = average_precision(running(flagged, keys, "score", "det_idx", "hit"), seen, keys, how)
    out = saved(out.select("label", "iou", "bin", "num_gt", "ap"))
    defined = F.coalesce(F.avg(F.when(F.col("num_gt") > 0, F.col("ap"))), F.lit(-1.0)).alias("ap")
    rolled = out.groupingSets([[], ["label"], ["iou"], ["label", "iou"], ["bin"], ["label", "bin"], ["label", "iou", "bin"]], "label", "iou", "bin")
    return rolled.agg(F.sum("num_gt").alias("num_gt"), defined, F.grouping_id().alias("level"))


def nds_ap(pred: DataFrame, gt: DataFrame, thresholds: Sequence[float] = (0.5, 1.0, 2.0, 4.0), min_recall: float = 0.1, min_precision: float = 0.1) -> DataFrame:
    """(label, threshold, ap) of distance matching: precision interpolated linearly at 101 recalls (0 beyond the
    largest), those over min_recall averaged after taking off min_precision. Classes without ground truth have 0."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    found = candidates_by_distance(pred, gt, max(thresholds)).withColumn("threshold", each).filter(F.col("value") < F.col("threshold"))
    hits = match(found, True, ["threshold"]).select("threshold", (-F.col("det_idx")).alias("det_idx"), F.lit(True).alias("hit"))
    flagged = pred.select("label", "score", (-F.col("det_idx")).alias("det_idx")).withColumn("threshold", each).join(hits, ["threshold", "det_idx"], "left")
    curve = running(flagged.withColumn("hit", F.coalesce("hit", F.lit(False))), ["label", "threshold"], "score", "det_idx", "hit")
    totals = gt.groupBy("label").agg(F.count("*").alias("num_gt"))
    steps = saved(curve.groupBy("label", "threshold", "tp").agg(F.min("seen").alias("first"), F.max("seen").alias("last")))
    labels = pred.select("label").unionByName(gt.select("label")).distinct()
    grid = labels.join(totals, "label", "left").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(100))))
    lowest = steps.groupBy("label", "threshold").agg(F.min("tp").alias("low"), F.max("tp").alias("high"), F.min(F.struct("first", "tp")).alias("start"))
    grid = grid.join(lowest, ["label", "threshold"], "left").withColumn("at", F.floor(F.col("k") * F.col("num_gt") / 100))
    here, there = (steps.select("label", "threshold", F.col("tp").alias("at"), (F.col("tp") / F.col(c)).alias(f"p_{c}")) for c in ("last", "first"))
    grid = grid.join(here, ["label", "threshold", "at"], "left").join(there.withColumn("at", F.col("at") - 1), ["label", "threshold", "at"], "left")
    part = F.col("k") * F.col("num_gt") / 100 - F.col("at")
    inner = F.col("p_last") + F.when(part > 0, part * (F.col("p_first") - F.col("p_last"))).otherwise(0.0)
    value = F.when(F.col("k") * F.col("num_gt") > 100 * F.col("high"), 0.0).when(F.col("at") < F.col("low"), F.col("start.tp") / F.col("start.first")).otherwise(inner)
    over = F.greatest(F.coalesce(value, F.lit(0.0)) - min_precision, F.lit(0.0)) / (1 - min_precision)
    return grid.filter(F.col("k") > round(100 * min_recall)).groupBy("label", "threshold").agg(F.avg(over).alias("ap"))


ERRORS = ("trans", "vel", "scale", "orient", "attr")


def match_errors(pred: DataFrame, gt: DataFrame, below: float = 2.0, half_turn: Sequence[int] = ()) -> DataFrame:
    """det_idx, label, score and the errors of every distance match: ground distance, velocity difference, one minus
    the IoU of the sizes, heading difference (modulo half a turn for the classes of half_turn), attribute (0 or 1,
    null where the ground truth has none, that is a negative one)."""
    names = ("cx", "cy", "l", "w", "h", "yaw", "vx", "vy", "attr")
    pairs_ = match(candidates_by_distance(pred, gt, below), later_first=True)
    p = pred.select("det_idx", "label", "score", *[F.col(n).alias(f"p_{n}") for n in names])
    g = gt.select(F.col("box_idx").alias("gt_idx"), *[F.col(n).alias(f"g_{n}") for n in names])
    both = pairs_.join(p, "det_idx").join(g, "gt_idx")
    gap = lambda a, b: F.sqrt((F.col(f"p_{a}") - F.col(f"g_{a}")) ** 2 + (F.col(f"p_{b}") - F.col(f"g_{b}")) ** 2)
    small = F.least("p_l", "g_l") * F.least("p_w", "g_w") * F.least("p_h", "g_h")
    union = F.col("p_l") * F.col("p_w") * F.col("p_h") + F.col("g_l") * F.col("g_w") * F.col("g_h") - small
    period = F.when(F.col("label").isin(*half_turn), F.pi()).otherwise(2 * F.pi()) if half_turn else 2 * F.pi()
    turn = F.abs(F.expr("pmod(g_yaw - p_yaw + _half, 2 * _half)") - F.col("_half"))
    attr = F.when(F.col("g_attr") < 0, None).otherwise((F.col("p_attr") != F.col("g_attr")).cast("double"))
    errors = {"trans": gap("cx", "cy"), "vel": gap("vx", "vy"), "scale": 1 - F.try_divide(small, union), "orient": turn, "attr": attr}
    return both.withColumn("_half", period / 2).withColumns(errors).select("det_idx", "label", "score", *ERRORS)


def tp_errors(pred: DataFrame, gt: DataFrame, below: float = 2.0, min_recall: float = 0.1, half_turn: Sequence[int] = ()) -> DataFrame:
    """(label, metric, error) for the classes of gt and pred: running means of the errors in match order, read at the
    confidences of the recalls from just over min_recall to the largest one reached, and averaged. 1 if there is no
    such recall or no match; a mean before its first value is 0, and all ones if there never is a value."""
    found = saved(match_errors(pred, gt, below, half_turn))
    flagged = pred.select("label", "score", "det_idx").join(found.select("det_idx", F.lit(True).alias("hit")), "det_idx", "left")
    flagged = flagged.select("label", "score", (-F.col("det_idx")).alias("tie"), F.coalesce("hit", F.lit(False)).alias("hit"))
    steps = running(flagged, ["label"], "score", "tie", "hit").groupBy("label", "tp").agg(F.max("score").alias("first"), F.min("score").alias("last"))
    steps = saved(steps)
    tps = found.withColumn("tie", -F.col("det_idx"))
    sums = {f"{k}_{e}": (F.coalesce(F.col(e), F.lit(0.0)) if k == "sum" else F.col(e).isNotNull().cast("long")) for e in ERRORS for k in ("sum", "num")}
    tps = running_sums(tps, ["label"], "score", "tie", sums | {"t": F.lit(1).cast("long")})
    any_value = tps.groupBy("label").agg(*[F.max(f"num_{e}").alias(f"all_{e}") for e in ERRORS])
    mean = lambda e: F.when(F.col(f"all_{e}") == 0, 1.0).otherwise(F.coalesce(F.try_divide(F.col(f"sum_{e}"), F.col(f"num_{e}")), F.lit(0.0)))
    tps = tps.join(any_value, "label").select("label", "t", F.col("score").alias("conf"), *[mean(e).alias(e) for e in ERRORS])
    earliest = tps.groupBy("label", "conf").agg(*[F.min_by(e, "t").alias(f"e_{e}") for e in ERRORS])
    tps = saved(tps.join(earliest, ["label", "conf"]))

    totals = gt.groupBy("label").agg(F.count("*").alias("n"))
    reach = steps.groupBy("label").agg(F.min("tp").alias("low"), F.max("tp").alias("high"), F.max("first").alias("best"))
    grid = totals.join(reach, "label").withColumn("k", F.explode(F.sequence(F.lit(round(100 * min_recall) + 1), F.lit(100))))
    grid = grid.withColumn("x", F.col("k") * F.col("n") / 100).withColumn("at", F.floor("x")).filter((F.col("x") <= F.col("high")) & (F.col("high") > 0))
    grid = grid.join(steps.select("label", F.col("tp").alias("at"), "last"), ["label", "at"], "left")
    names = ["conf", *ERRORS, *[f"e_{e}" for e in ERRORS]]
    lower, upper = (tps.select("label", (F.col("t") - d).alias("at"), *[F.col(c).alias(f"{s}_{c}") for c in names]) for s, d in (("lo", 1), ("up", 0)))
    grid = grid.join(lower, ["label", "at"], "left").join(upper, ["label", "at"], "left")
    conf = F.when(F.col("at") < F.col("low"), F.col("best")).when(F.col("x") == F.col("at"), F.col("last")).otherwise(F.col("last") + (F.col("x") - F.col("at")) * (F.col("lo_conf") - F.col("last")))
    grid = grid.withColumn("conf", conf)
    part = F.try_divide(F.col("conf") - F.col("lo_conf"), F.col("up_conf") - F.col("lo_conf"))
    out = []
    for e in ERRORS:
        between = F.col(f"lo_e_{e}") + part * (F.col(f"up_{e}") - F.col(f"lo_e_{e}"))
        value = F.when(F.col("up_conf").isNull(), F.col(f"lo_e_{e}")).when(F.col("lo_conf").isNull() | (F.col("conf") >= F.col("up_conf")), F.col(f"up_e_{e}")).otherwise(F.coalesce(between, F.col(f"up_e_{e}")))
        out.append(F.avg(value).alias(e))
    labels = pred.select("label").unionByName(gt.select("label")).distinct()
    means = labels.join(grid.groupBy("label").agg(*out), "label", "left")
    return means.unpivot("label", list(ERRORS), "metric", "error").withColumn("error", F.coalesce("error", F.lit(1.0)))


#: Classes whose heading counts modulo half a turn, and errors that are not taken of a class.
HALF_TURN = ("barrier",)
SKIPPED = {"traffic_cone": ("attr", "vel", "orient"), "barrier": ("attr", "vel")}


@dataclass(frozen=True)
class Scoring:
    """What the composite score takes in. classes: the labels that count, with or without boxes (None: those of either
    table); thresholds: distances of AP; below: the one of the errors; metrics: the errors that count; half_turn: labels
    whose heading counts modulo half a turn; skips: errors that are not taken of a label."""

    classes: tuple[int, ...] | None = None
    thresholds: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)
    below: float = 2.0
    min_recall: float = 0.1
    min_precision: float = 0.1
    weight: float = 5.0
    metrics: tuple[str, ...] = ERRORS
    half_turn: tuple[int, ...] = ()
    skips: tuple[tuple[int, str], ...] = ()

    def __post_init__(self) -> None:
        if self.below not in self.thresholds:
            raise ValueError("the distance of the errors is one of the thresholds")
        if bad := {*self.metrics, *[m for _, m in self.skips]} - set(ERRORS):
            raise ValueError(f"no such errors: {sorted(bad)}")
        if self.classes is not None and not self.classes:
            raise ValueError("a score needs a class")

    @classmethod
    def of_names(cls, names: Sequence[str], **options) -> Scoring:
        """Labels are positions in names; half turns and skips follow from them."""
        skips = tuple((i, m) for i, n in enumerate(names) for m in SKIPPED.get(n, ()))
        return cls(classes=tuple(range(len(names))), half_turn=tuple(i for i, n in enumerate(names) if n in HALF_TURN), skips=skips, **options)


def class_errors(pred: DataFrame, gt: DataFrame, how: Scoring = Scoring()) -> DataFrame:
    """(label, metric, error) for every class and metric that counts: 1 for a class without matches, null where skipped."""
    labels = _labels(pred, gt, how).withColumn("metric", F.explode(F.array(*map(F.lit, how.metrics))))
    found = tp_errors(pred, gt, how.below, how.min_recall, how.half_turn)
    skipped = F.lit(False)
    for label, metric in how.skips:
        skipped = skipped | ((F.col("label") == label) & (F.col("metric") == metric))
    return labels.join(found, ["label", "metric"], "left").withColumn("error", F.when(~skipped, F.coalesce("error", F.lit(1.0))))


def _labels(pred: DataFrame, gt: DataFrame, how: Scoring) -> DataFrame:
    if how.classes is None:
        return pred.select("label").unionByName(gt.select("label")).distinct()
    kind = pred.schema["label"].dataType
    return pred.sparkSession.createDataFrame([(c,) for c in how.classes], f"label {kind.simpleString()}")


def detection_score(pred: DataFrame, gt: DataFrame, how: Scoring = Scoring()) -> DataFrame:
    """One row: mean_ap, the mean of each error that counts, and score = (weight * mean_ap + sum of max(0, 1 - error)) over
    (weight + number of errors). Means leave skipped classes out; an error that is skipped everywhere is null and adds
    nothing. Without classes the score is 0."""
    if how.classes is not None:
        pred, gt = (x.filter(F.col("label").isin(*how.classes)) for x in (pred, gt))
    ap = nds_ap(pred, gt, how.thresholds, how.min_recall, how.min_precision).groupBy("label").agg(F.avg("ap").alias("ap"))
    ap = _labels(pred, gt, how).join(ap, "label", "left").agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("mean_ap"))
    errors = class_errors(pred, gt, how).groupBy().pivot("metric", list(how.metrics)).agg(F.avg("error"))
    both = ap.crossJoin(errors)  # a row each
    gained = sum((F.coalesce(F.greatest(F.lit(0.0), 1 - F.col(e)), F.lit(0.0)) for e in how.metrics), F.lit(0.0))
    return both.withColumn("score", F.coalesce((how.weight * F.col("mean_ap") + gained) / (how.weight + len(how.metrics)), F.lit(0.0)))
