"""Cutting lineage with a table in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session whose executors live in the driver's process (tests) gets a
    local folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cuboid-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again. done: saved tables that only df was made of, deleted
    then."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scene-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    drop(*done)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes saved tables; nothing that is yet to be computed may read them."""
    for t in tables:
        spark = t.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
