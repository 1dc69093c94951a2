"""State that grows with a stream: matches of a metric, and a database of the newest objects of each class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Log:
    """A Parquet table that a stream appends to, once per batch: a batch's rows are written under its number, so a
    batch that is run again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def follow(self, stream: DataFrame, checkpoint: str, work=None, mode: str = "append") -> StreamingQuery:
        """Starts appending work(batch) (the batch itself by default) until the available rows are done. mode: what a batch
        of an aggregation holds (update: changed rows, complete: all of them)."""

        def write(batch: DataFrame, number: int) -> None:
            (work(batch) if work else batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def rows(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")

    def last(self) -> DataFrame:
        """The rows of the last batch: the whole of an aggregation whose batches are complete."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [x.getPath().getName() for x in where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
        return self.spark.read.parquet(f"{self.path}/batch={max(int(n[6:]) for n in names if n.startswith('batch='))}")


def newest(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n newest rows of every key (a bounded database of objects: the cap is the feature)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts per event-time window and keys, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
