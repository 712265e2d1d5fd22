"""Exact percentiles of groups of any size, by selection instead of sorting.

A percentile lies between two neighbours in the order of a group's values.  A pass over the rows
counts, in ``BINS`` bins of equal width between the bounds of each bracket, how many values
there are, and keeps the least and greatest of each bin; the bin with the wanted ranks is the next
bracket, so it shrinks by about ``BINS`` a pass and always to values that are there.  A bracket
is settled if its ends are equal or the two ranks fall into different bins; the values of one with
at most ``SORT_ROWS`` rows are sorted.  Counts are combined before the shuffle, so a pass moves at
most ``BINS`` rows for each group, fraction and task, and no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_path

BINS, SORT_ROWS = 1024, 1 << 16
#: Passes at most; only a group that spans more than half of the range of doubles needs as many.
PASSES = 16


def _written(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "brackets")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _within(base: DataFrame, brackets: DataFrame) -> DataFrame:
    return base.join(brackets, "g").where((F.col("v") >= F.col("least")) & (F.col("v") <= F.col("most")))


def percentiles(df: DataFrame, by: list[str], value: str, fractions: list[float], out: str = "value") -> DataFrame:
    """by, fraction and the percentile (between two values by their distance) of each group.

    Null values are left out, and so are groups without others; null keys are a group.  NaN and
    infinite values are an error.
    """
    keys = [F.col(f"`{c}`") for c in by] or [F.lit(0).alias("all")]
    base = df.select(F.struct(*keys).alias("g"), F.col(f"`{value}`").cast("double").alias("v")).where("v is not null")
    odd = F.isnan("v") | (F.abs("v") == float("inf"))
    head = _written(base.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.bool_or(odd).alias("odd")))
    if not head.where("odd").isEmpty():
        raise ValueError(f"{value} has values that aren't finite")
    place = F.col("f") * (F.col("n") - 1)
    now = head.withColumn("f", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    now = now.select("g", "f", place.alias("place"), F.floor(place).alias("low"), F.ceil(place).alias("high"), "least", "most", F.lit(0).cast("bigint").alias("before"), "n", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    now = _written(now)
    for _ in range(PASSES):
        wide = F.col("a").isNull() & (F.col("least") < F.col("most")) & (F.col("n") > SORT_ROWS)
        if now.where(wide).isEmpty():
            break
        cell = F.least(F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * BINS), F.lit(BINS - 1))
        bins = _within(base, now.where(wide).select("g", "f", "least", "most")).groupBy("g", "f", cell.alias("cell")).agg(F.count("*").alias("c"), F.min("v").alias("x"), F.max("v").alias("z"))
        line = Window.partitionBy("g", "f").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        bins = bins.withColumn("earlier", F.coalesce(F.sum("c").over(line), F.lit(0))).join(now.where(wide).select("g", "f", "low", "high", "before"), ["g", "f"])
        has = lambda rank: (F.col("before") + F.col("earlier") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("earlier") + F.col("c"))
        one, two = (F.max(F.when(has(r), F.struct("cell", "x", "z", "earlier", "c"))) for r in ("low", "high"))
        found = bins.groupBy("g", "f").agg(one.alias("one"), two.alias("two"))
        same = F.col("one.cell") == F.col("two.cell")
        next_ = now.where(wide).join(found, ["g", "f"]).select("g", "f", "place", "low", "high", F.col("one.x").alias("least"), F.col("one.z").alias("most"), (F.col("before") + F.col("one.earlier")).alias("before"), F.col("one.c").alias("n"), F.when(~same, F.col("one.z")).alias("a"), F.when(~same, F.col("two.x")).alias("b"))
        now = _written(now.where(~wide).unionAll(next_))
    equal = F.col("least") == F.col("most")
    sort = now.where(F.col("a").isNull() & ~equal)
    rank = F.col("before") + F.row_number().over(Window.partitionBy("g", "f").orderBy("v")) - 1
    ranked = _within(base, sort.select("g", "f", "low", "high", "least", "most", "before", "place")).withColumn("rank", rank)
    at = lambda r: F.max(F.when(F.col("rank") == F.col(r), F.col("v")))
    sorted_ = ranked.where("rank = low or rank = high").groupBy("g", "f", "place", "low").agg(at("low").alias("a"), F.max("v").alias("b"))
    settled = now.where(F.col("a").isNotNull() | equal).select("g", "f", "place", "low", F.coalesce("a", "least").alias("a"), F.coalesce("b", "least").alias("b"))
    names: list[Column] = [F.col(f"g.`{c}`").alias(c) for c in by]
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("low"))
    return settled.unionAll(sorted_).select(*names, F.col("f").alias("fraction"), between.alias(out))
