"""Shared helpers of the training-data operators: tables, shared storage, Arrow maps, hashing.

Nothing here collects document-sized data to the driver.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"

#: Folder used where no cluster names one (tests, local mode).
LOCAL_SHARED = "file:///tmp/tessera-shared"

_leftovers: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, if Spark is local, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (shared or LOCAL_SHARED).rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder through Hadoop's file system, whatever store it is in."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for path, spark in list(_leftovers.items()):
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone when the process ends
            pass


atexit.register(_sweep)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared store, removed when the process ends."""
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    _leftovers[path] = spark
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df once as Parquet in the shared store and return the written table.

    Unlike a cached DataFrame it survives the loss of executors. Call release() on the result when no
    later step reads it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(*frames: DataFrame) -> None:
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path and _leftovers.pop(path, None) is not None:
            delete_path(df.sparkSession, path)


#: Spark's own setting (4.0 and later) by which a finished query removes its shuffle files.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are run inside leave no shuffle files behind; the session's setting is put back afterwards."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def columns_or_null(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Select wanted columns (name -> type); other columns, whatever they are called, are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


#: Most rows, and about the most bytes, of what a function of map_arrow() is given at a time.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with small batches. Spark's own, of 64 MB by default, are cut here, so no setting of the session changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[pa.RecordBatch]:
            for b in batches:
                step = max(1, min(BATCH_ROWS, int(b.num_rows * BATCH_BYTES / max(1, b.nbytes))))
                for a in range(0, max(1, b.num_rows), step):
                    yield b.slice(a, step)

        return fn(cut())

    return df.mapInArrow(run, schema)


#: A slice of an Arrow batch handed to vector code holds at most so many bytes of text (one longer text comes alone).
SLICE_BYTES = 4 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of bounded text size, so that memory follows the slice and not the batch."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_input(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and named further columns) alone."""
    return df.select("doc_id", "text", *more)


def apart(key: str) -> Column:
    """A join key (of a long) that an aggregation by the same column is not already dealt by.

    Joined straight to such an aggregation a hot key could not be split; with a shuffle on either side Spark's
    adaptive execution cuts its partition into parts. The aggregated side has one row for each key.
    """
    return F.col(key).bitwiseXOR(F.lit(1))
