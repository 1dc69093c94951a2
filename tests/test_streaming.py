"""A metric that a stream keeps up to date against the batch job."""

import pytest
from pyspark.sql import functions as F

from cuboid.operators import detection
from cuboid.plans.scene import view
from cuboid.queries import frame_files
from cuboid.streaming.metrics import StreamedPrecision

SF = "/root/testdata/sf0.001"


def batch(spark, ious, how, frames=None):
    pred, gt = view(spark, SF, "pred"), view(spark, SF, "gt")
    if frames is not None:
        pred, gt = pred.filter(f"frame_id < {frames}"), gt.filter(f"frame_id < {frames}")
    out = detection.map3d(pred, gt, ious, how=how).filter("label IS NOT NULL AND iou IS NOT NULL AND bin IS NOT NULL")
    return {(r.label, r.iou): (r.num_gt, pytest.approx(r.ap, abs=1e-9)) for r in out.collect()}


def streamed(metric, how):
    return {(r.label, r.iou): (r.num_gt, r.ap) for r in metric.compute(how).collect()}


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    """Three files of frames one by one, then two more days; a stream without news changes nothing."""
    frames = f"{tmp_path}/frames"
    frame_files(spark, SF, f"{tmp_path}/all", 3)
    every = spark.read.parquet(f"{tmp_path}/all")
    every.filter("frame_id < 12").repartitionByRange(2, "frame_id").write.parquet(frames)
    stream = lambda: spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(frames)
    metric = StreamedPrecision(spark, f"{tmp_path}/metric", (0.1, 0.3))
    metric.update(stream())
    for how in ("r40", "r11", "all_points"):
        assert streamed(metric, how) == batch(spark, (0.1, 0.3), how, 12)
    every.filter("frame_id >= 12").coalesce(1).write.mode("append").parquet(frames)
    again = StreamedPrecision(spark, f"{tmp_path}/metric", (0.1, 0.3))  # as after a restart
    again.update(stream())
    want = batch(spark, (0.1, 0.3), "r40")
    assert streamed(again, "r40") == want
    again.update(stream())
    assert streamed(again, "r40") == want
    assert again.state().filter("iou IS NOT NULL").agg(F.sum("n")).first()[0] == 2 * view(spark, SF, "pred").count()


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    frame_files(spark, SF, f"{tmp_path}/all", 1)
    rows = spark.read.parquet(f"{tmp_path}/all")
    metric = StreamedPrecision(spark, f"{tmp_path}/metric", (0.1,))
    for _ in range(2):  # the second run stands for one after a crash before the batch was committed
        metric.matched(rows).write.mode("overwrite").parquet(f"{metric.flags.path}/batch=0")
    assert metric.flags.rows().count() == rows.count()


def test_buckets_are_ties(spark, tmp_path):
    metric = StreamedPrecision(spark, f"{tmp_path}/m", (0.5,), buckets=4)
    got = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.24, 0.25, 0.99, 1.0, 7.0)], "score double").select(metric.bucket().alias("b"))
    assert [r.b for r in got.collect()] == [0, 0, 0, 1, 3, 3, 3]
    with pytest.raises(ValueError):
        StreamedPrecision(spark, f"{tmp_path}/m", (0.0,))
