"""Scratch tables in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Used only where ``spark.checkpoint.dir`` is unset and all of Spark runs on one machine, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (master.startswith("local-cluster") or not master.startswith("local")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL_DEFAULT


_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path that is removed by ``release`` or when Python exits."""
    if not _made:
        atexit.register(_release_late, spark)
    _made.append(f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Removes all scratch of this process, once no result is read any more; returns how many paths."""
    n = len(_made)
    while _made:
        remove(spark, _made.pop())
    return n


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _release_late(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session may have ended before
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def shipped(spark: SparkSession, data: bytes, label: str) -> str:
    """Writes data to the shared folder and has Spark bring it to every executor; returns the name for ``SparkFiles.get``."""
    path = f"{scratch_path(spark, label)}/{label}-{uuid.uuid4().hex}.bin"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    for a in range(0, len(data), 1 << 20):
        out.write(bytearray(data[a : a + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return urlparse(path).path.rsplit("/", 1)[-1]


def drop(df: DataFrame) -> None:
    """Removes a scratch table that nothing reads any more."""
    remove(df.sparkSession, df.scratch_path)
    _made.remove(df.scratch_path)
