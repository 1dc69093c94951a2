"""Average precision that a stream keeps up to date.

Two steps follow each other in update(). Every micro-batch of whole frames is matched by the same joins as a batch job
and written under its number, so that a batch that runs again replaces itself. The rows written then go through a
streaming aggregation, whose state, held by Spark's state store and recovered from its checkpoint, counts detections and hits
per class, IoU and score bucket, and boxes per class. Its size depends on classes, IoUs and buckets, not on the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuboid.operators import detection
from cuboid.streaming.updates import Log

KEYS = ["label", "iou", "bucket"]


class StreamedPrecision:
    """The state of one metric in a folder that driver and executors share. buckets: how finely scores from 0 to 1 are told
    apart; detections of one bucket count as ties that are seen together."""

    def __init__(self, spark: SparkSession, folder: str, ious: Sequence[float] = (0.5,), buckets: int = 1 << 20, fmt: str = "XYZLWHYPR"):
        if not ious or min(ious) <= 0:
            raise ValueError("IoUs are positive")
        self.spark, self.folder, self.ious, self.buckets, self.fmt = spark, folder.rstrip("/"), tuple(map(float, ious)), buckets, fmt
        self.flags, self.states = Log(spark, f"{self.folder}/flags"), Log(spark, f"{self.folder}/states")

    def bucket(self):
        return F.least(F.greatest(F.floor(F.col("score") * self.buckets), F.lit(0)), F.lit(self.buckets - 1)).cast("long")

    def matched(self, batch: DataFrame) -> DataFrame:
        """(label, iou, bucket, hit) of every detection of a batch of whole frames, and a row of label alone for each box."""
        pred, gt = batch.filter("kind = 'pred'"), batch.filter("kind = 'gt'").withColumnRenamed("idx", "box_idx")
        pred = pred.withColumnRenamed("idx", "det_idx")
        each = F.explode(F.array(*map(F.lit, self.ious)))
        found = detection.candidates_by_iou(pred, gt, min(self.ious), self.fmt).withColumn("iou", each).filter(-F.col("value") >= F.col("iou"))
        hits = detection.match(found, groups=["iou"]).select("iou", "det_idx", F.lit(True).alias("hit"))
        flagged = pred.select("label", "det_idx", self.bucket().alias("bucket")).withColumn("iou", each).join(hits, ["iou", "det_idx"], "left")
        rows = flagged.select("label", "iou", "bucket", F.coalesce("hit", F.lit(False)).alias("hit"))
        return rows.unionByName(gt.select("label", F.lit(None).cast("double").alias("iou"), F.lit(None).cast("long").alias("bucket"), F.lit(False).alias("hit")))

    def update(self, stream: DataFrame) -> None:
        """Takes in what a stream has to offer now. stream: kind (pred or gt), frame_id, idx (unique), label, score (null for
        boxes) and the columns of the box format; all rows of a frame come in one micro-batch, as files of whole frames do."""
        self.flags.follow(stream, f"{self.folder}/checkpoint-flags", self.matched).awaitTermination()
        rows = self.spark.readStream.schema("label long, iou double, bucket long, hit boolean").option("recursiveFileLookup", "true").parquet(f"{self.flags.path}/batch=*")
        state = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
        self.states.follow(state, f"{self.folder}/checkpoint-states", mode="complete").awaitTermination()

    def state(self) -> DataFrame:
        """(label, iou, bucket, n, hits): the counts as they stand; a row per class without iou and bucket counts its boxes."""
        return self.states.last()

    def compute(self, how: str = "r40") -> DataFrame:
        """(label, iou, num_gt, ap) of every class with boxes or detections, as detection.average_precision gives them."""
        state = self.state()
        gt = state.filter("iou IS NULL").select("label", F.col("n").alias("num_gt"))
        curve = state.filter("iou IS NOT NULL")
        w = Window.partitionBy("label", "iou").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)  # at most self.buckets rows
        curve = curve.select("label", "iou", F.sum("hits").over(w).alias("tp"), F.sum("n").over(w).alias("seen"))
        totals = state.select("label").distinct().join(gt, "label", "left").na.fill(0, ["num_gt"]).withColumn("iou", F.explode(F.array(*map(F.lit, self.ious))))
        return detection.average_precision(curve, totals, ["label", "iou"], how).select("label", "iou", "num_gt", "ap")
