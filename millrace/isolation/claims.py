"""Names that only one of all who want them gets, on each kind of store."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..sources.scratch import file_system


def _link(spark: SparkSession, path: str, data: bytes) -> bool:
    """Local file system: a hard link from the finished file, which fails if the name is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
    os.makedirs(os.path.dirname(target), exist_ok=True)
    own = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
    try:
        with open(own, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.link(own, target)
        return True
    except FileExistsError:
        return False
    finally:
        if os.path.exists(own):
            os.unlink(own)


def _rename(spark: SparkSession, path: str, data: bytes) -> bool:
    """HDFS: a rename, which the name node refuses if the name is there."""
    fs, target = file_system(spark, path)
    _, own = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(data))
    out.close()
    won = fs.rename(own, target)
    if not won:
        fs.delete(own, False)
    return won


#: How a finished file gets a name that nobody else may get, by the scheme of the store.
#: Add a conditional put for an object store here; a store without an entry is refused.
CLAIMS: dict[str, Callable[[SparkSession, str, bytes], bool]] = {"file": _link, "hdfs": _rename}


def claim(spark: SparkSession, path: str, data: bytes) -> bool:
    """Makes a file with this content; False if the name is taken."""
    scheme = file_system(spark, path)[0].getUri().getScheme()
    if scheme not in CLAIMS:
        raise ValueError(f"no way is known to claim a name in a store of kind {scheme}: add one to CLAIMS")
    return CLAIMS[scheme](spark, path, data)
