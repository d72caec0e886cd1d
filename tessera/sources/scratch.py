"""Scratch folders in the store that driver and executors share."""

from __future__ import annotations

import atexit

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder below spark.checkpoint.dir (a local one where that is unset and Spark is local), removed at the end."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file:///tmp/tessera-shared"
    path = f"{shared.rstrip('/')}/{name}"
    _made.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone when the process ends
            pass
