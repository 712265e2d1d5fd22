"""Folders for what a query writes, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where it is unset and all of Spark runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (master.startswith("local-cluster") or not master.startswith("local")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "/tmp/checkpoints"


def new_path(spark: SparkSession, label: str) -> str:
    """A path that is removed by ``release`` or when Python exits."""
    if not _made:
        atexit.register(_release_late, spark)
    _made.append(f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Removes what queries have written so far, once nothing reads it any more; returns how many paths."""
    gone = 0
    while _made:
        fs, p = file_system(spark, _made.pop())
        gone += bool(fs.delete(p, True))
    return gone


def _release_late(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session may have ended before
        pass


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path, which reach any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
