"""Deletion vectors: for each file a bitmap of the rows that are gone, in pieces of 32,768 rows.

A mark is a column of (file, pos) that a scan adds to each row, pos its place in the file.  The
bitmaps of a statement are a table of its own (file, bucket, bits), built and merged by Spark's
bitmap functions; a scan joins it and leaves out rows whose bit is set.  A piece takes 4 KB
however many rows of it are gone, so the size of a join is known from the log before it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, bucket bigint, bits binary"
#: Bytes of a piece with its key, about, and of all pieces that a scan's tasks are sent whole; more are joined by shuffle.
PIECE_BYTES, BROADCAST_BYTES = 4200, 16 << 20


def free_name(names: list[str], wanted: str) -> str:
    """``wanted``, or that with underscores, so that no column of ``names`` has it."""
    while wanted.lower() in {n.lower() for n in names}:
        wanted += "_"
    return wanted


def marked(scan: DataFrame, columns: list[Column], mark: str) -> DataFrame:
    """Columns of a Parquet scan, and the mark of each row."""
    meta = scan.metadataColumn("_metadata")
    file = F.concat(F.lit("data/"), F.substring_index(meta.getField("file_path"), "/", -2))
    return scan.select(*columns, F.struct(file.alias("file"), meta.getField("row_index").alias("pos")).alias(mark))


def _place(mark: str) -> tuple[Column, Column, Column]:
    at = F.col(f"`{mark}`.pos") + 1
    return F.col(f"`{mark}`.file"), F.bitmap_bucket_number(at), F.bitmap_bit_position(at)


def built(hits: DataFrame, mark: str) -> DataFrame:
    """file, bucket, bits of the rows that carry these marks."""
    file, bucket, bit = _place(mark)
    return hits.select(file.alias("file"), bucket.alias("bucket"), bit.alias("bit")).groupBy("file", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def read(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One row for each piece, whatever the number of statements that took rows of it."""
    rows = spark.read.schema(SCHEMA).parquet(*folders)
    return rows.groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")) if len(folders) > 1 else rows


def _joined(df: DataFrame, mark: str, vectors: DataFrame, pieces: int, how: str) -> tuple[DataFrame, str, Column]:
    """df with the bits of each row's piece, the column that has them, and whether the row's bit is set."""
    bits = free_name(df.columns, "gone")
    v = vectors.select(F.struct("file", "bucket", "bits").alias(bits))
    if pieces * PIECE_BYTES <= BROADCAST_BYTES:
        v = F.broadcast(v)
    file, bucket, bit = _place(mark)
    byte = F.conv(F.hex(F.substring(F.col(f"`{bits}`.bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    on = (F.col(f"`{bits}`.file") == file) & (F.col(f"`{bits}`.bucket") == bucket)
    return df.join(v, on, how), bits, F.getbit(byte, (bit % 8).cast("int")) == 1


def without(df: DataFrame, mark: str, vectors: DataFrame, pieces: int) -> DataFrame:
    """Rows of a marked scan that aren't gone."""
    out, bits, gone = _joined(df, mark, vectors, pieces, "left")
    return out.where(F.col(bits).isNull() | ~gone).drop(bits)


def only(df: DataFrame, mark: str, vectors: DataFrame, pieces: int) -> DataFrame:
    """Rows of a marked scan whose bit is set."""
    out, bits, gone = _joined(df, mark, vectors, pieces, "inner")
    return out.where(gone).drop(bits)


def meet(a: DataFrame, b: DataFrame) -> bool:
    """Whether any row is in both."""
    both = a.join(b.select("file", "bucket", F.col("bits").alias("other")), ["file", "bucket"])
    shared = both.select("file", "bucket", F.explode(F.array("bits", "other")).alias("bits")).groupBy("file", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return not shared.where(F.bitmap_count("bits") > 0).isEmpty()
