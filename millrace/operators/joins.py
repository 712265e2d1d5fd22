"""Joins that equality alone doesn't express, without quadratic plans.

Helper columns get names that no input has, so inputs may have columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key and time bucket in an as-of join, about; buckets are made small enough for it.
BUCKET_ROWS = 1 << 20
#: Points of a bin of a range join, about; fuller ones are dealt out to parts.
BIN_ROWS = 1 << 16
#: A key of a salted join is hot if it has more than one in so many rows; so there are fewer hot keys than that.
HOT_SHARE = 1000


def unused(name: str, *frames: DataFrame) -> str:
    """The name, or a longer one that no frame has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, out: str, bucket_seconds: int | None = None) -> DataFrame:
    """Adds to each row of left the ``value`` of right's last row with the same key and a time not later.

    Time is cut into buckets, so that a key with very many rows is spread over tasks:
    within a bucket the last value is carried along the rows; across buckets it comes
    from one row for each key and bucket.  Without ``bucket_seconds`` a bucket is a day, or
    as much less as the fullest day of any key asks for.  Among right rows of one time the
    greatest value counts.  Rows of left without such a row get null; so do null keys or
    times.  Repeated rows of left are answered each.
    """
    r = right.where(F.col(by).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    seconds = lambda: F.unix_seconds(F.col(at).cast("timestamp"))
    if bucket_seconds is None:
        day = F.floor(seconds() / 86400)
        rows = left.where(F.col(by).isNotNull()).select(F.col(by).alias("k"), day.alias("d")).unionAll(r.select(F.col(by).alias("k"), day.alias("d")))
        fullest = rows.groupBy("k", "d").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        bucket_seconds = max(1, int(86400 * min(1.0, BUCKET_ROWS / max(fullest, 1))))
    b, side, v, here, last, carry = (unused(n, left, right) for n in ("bucket__", "side__", "value__", "here__", "last__", "carry__"))
    bucket = F.floor(seconds() / bucket_seconds)
    kind = right.schema[value].dataType
    answered = left.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    a = answered.select("*", bucket.alias(b), F.lit(1).alias(side), F.lit(None).cast(kind).alias(v))
    rr = r.select(F.col(by), F.col(at), bucket.alias(b), F.lit(0).alias(side), F.col(value).alias(v))
    within = Window.partitionBy(by, b).orderBy(at, side, v).rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(rr, allowMissingColumns=True).withColumn(here, F.last(v, ignorenulls=True).over(within)).where(F.col(side) == 1)
    # the last value of each earlier bucket, for the buckets that left has
    ends = rr.groupBy(by, b).agg(F.max_by(v, F.struct(at, v)).alias(last))
    asked = a.select(by, b).distinct().withColumn(last, F.lit(None).cast(kind))
    before = Window.partitionBy(by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    steps = ends.unionByName(asked).groupBy(by, b).agg(F.max(last).alias(last)).withColumn(carry, F.last(last, ignorenulls=True).over(before)).drop(last)
    names = [F.col(f"`{c}`") for c in left.columns]
    found = rows.join(steps, [by, b], "left").select(*names, F.coalesce(here, carry).alias(out))
    # rows without a key or time are not dealt out by it: all of them would meet in one task
    return found.unionAll(left.where(F.col(by).isNull() | F.col(at).isNull()).select(*names, F.lit(None).cast(kind).alias(out)))


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: int = 1) -> DataFrame:
    """Pairs with low <= point <= high for whole-number columns, by an equality join on bins.

    Bins have widths of powers of two, from ``width`` on, and a span lies on the level whose bins
    are as wide as itself, so it is repeated twice at most, however long it is; a point is in one
    bin of each level that spans have (64 at most).  A bin with more than ``BIN_ROWS`` points is
    dealt out to parts, each of which meets the bin's spans, so a burst of points is spread over
    tasks.  A pair is found once.  Null points and ends are in no pair.
    """
    level, at, part, parts, n = (unused(x, points, spans) for x in ("level__", "bin__", "part__", "parts__", "n__"))
    x, a, z = (F.col(f"`{c}`").cast("bigint") for c in (point, low, high))
    least = max(width - 1, 0).bit_length()
    s = spans.where(a <= z).withColumn(level, F.greatest(F.lit(least), F.when(z > a, F.coalesce(F.length(F.bin(F.try_subtract(z, a))), F.lit(63))).otherwise(0)).cast("int"))
    used = [r[0] for r in s.select(level).distinct().collect()]  # a row for each level
    bin_of = lambda v: F.call_function("shiftright", v, F.col(level))
    s = s.withColumn(at, F.explode(F.array_distinct(F.array(bin_of(a), bin_of(z)))))
    p = points.where(x.isNotNull()).withColumn(level, F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn(at, bin_of(x))
    full = p.groupBy(level, at).agg(F.count("*").alias(n)).where(F.col(n) > BIN_ROWS).select(level, at, F.ceil(F.col(n) / BIN_ROWS).cast("int").alias(parts))
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), F.coalesce(parts, F.lit(1)))
    p = p.join(full, [level, at], "left").withColumn(part, own).drop(parts)
    s = s.join(full, [level, at], "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(parts, F.lit(1)).cast("bigint") - 1))).drop(parts)
    return p.join(s, [level, at, part]).where((x >= a) & (x <= z)).drop(level, at, part)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Inner join for a left side with hot keys.

    A count, combined before the shuffle, tells which keys have more than a
    ``HOT_SHARE``-th of left's rows; only their rows are salted, and only right's rows of
    these keys are repeated for each salt.
    """
    salt, hot, n = (unused(x, left, right) for x in ("salt__", "hot__", "n__"))
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    total = left.count()
    top = counts.where(F.col(n) > F.lit(total) / HOT_SHARE).select(key, F.lit(True).alias(hot))  # fewer than HOT_SHARE rows
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
    a = left.join(F.broadcast(top), key, "left").withColumn(salt, F.when(F.col(hot), own).otherwise(F.lit(0).cast("bigint"))).drop(hot)
    each = F.when(F.col(hot), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    b = right.join(F.broadcast(top), key, "left").withColumn(salt, F.explode(each)).drop(hot)
    return a.join(b, [key, salt]).drop(salt)
