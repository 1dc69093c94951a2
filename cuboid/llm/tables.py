"""Small helpers on DataFrames that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuboid.llm.textops import slices


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session whose executors
    live in the driver's process (tests) gets a local one; on a cluster that is an error."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = f"file://{tempfile.mkdtemp(prefix='cuboid-')}"
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


#: Folders of the tables that saved() has written and nobody has dropped.
LIVE: set[str] = set()
_OWNED: ContextVar[set[str] | None] = ContextVar("_OWNED", default=None)
#: Settings of the writes: shuffle files go at a write's end, and a batch that a task exchanges with its Python process has
#: few rows and bytes, as a row may hold a long text or two large sets. Texts take less room with this codec than with the default one.
_WRITES = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
    "spark.sql.parquet.compression.codec": "zstd",
}


def saved(df: DataFrame, *done: DataFrame, by: str | None = None, batch: int = 1000, split: int | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    Spark deletes the shuffle files of the write at its end. done: saved tables that only df was made of, deleted
    then. by: a column of few values, each of which gets a folder. batch: rows of a batch that goes to Python, at most;
    for rows without texts or sets it may be more. split: bytes of files that a task reads, about; Spark's setting by default."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cuboid-{uuid.uuid4().hex}"
    writes = _WRITES | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    writes |= {"spark.sql.files.maxPartitionBytes": str(split)} if split else {}
    before = {k: spark.conf.get(k, None) for k in writes}
    for k, v in writes.items():
        spark.conf.set(k, v)
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    LIVE.add(path)
    if (owned := _OWNED.get()) is not None:
        owned.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    drop(*done)
    return out


@contextmanager
def owning() -> Iterator[set[str]]:
    """The folders of the tables that this thread saves within the block, for drop_paths(). Tables of other threads, or of
    blocks within this one, are not among them."""
    paths: set[str] = set()
    token = _OWNED.set(paths)
    try:
        yield paths
    finally:
        _OWNED.reset(token)


def drop(*tables: DataFrame) -> None:
    """Deletes saved tables; nothing that is yet to be computed may read them."""
    for t in tables:
        drop_paths(t.sparkSession, [t.saved_at])


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in list(paths):
        LIVE.discard(path)
        if (owned := _OWNED.get()) is not None:
            owned.discard(path)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(names: Iterable[str], name: str) -> str:
    """name, with so many underscores before it that no column has it."""
    have = {n.lower() for n in names}
    while name.lower() in have:
        name = f"_{name}"
    return name


def small(table: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """A saved table of a few short columns, to be broadcast in a join if it has at most so many rows; a larger one
    is left to Spark, which shuffles both sides and splits skewed keys."""
    return F.broadcast(table) if table.count() <= rows else table


def add_columns(
    df: DataFrame,
    columns: str,
    work: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    text: str,
    keep: list[str] | None = None,
    limit: int = 1 << 19,
    holds: bool = False,
) -> DataFrame:
    """df's columns (or those of keep) and new ones, given as DDL, that work computes for batches of rows.

    Batches hold about limit bytes of the column text. holds: whether work uses textops.HELD. New columns replace those
    of the same name."""
    new = T.StructType.fromDDL(columns)
    names = [f.name for f in new]
    rest = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    fields = {f.name: f for f in df.schema}
    out = T.StructType([fields[c] for c in rest] + list(new))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, limit, holds):
            made = work(batch)
            columns = [batch.column(c) for c in rest] + [made[n] for n in names]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)
