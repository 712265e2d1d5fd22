"""Connected components by alternating large-star and small-star steps.

Every step is joins and minimum aggregates, so no neighbourhood is ever gathered in
one place.  The minima are written before they are joined, so that both sides of the
join are dealt out for it and adaptive execution can split the rows of a node with
very many neighbours; each round is written to the shared folder, which cuts lineage.
Rounds end when every edge leads from a node with no other edge to a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, written


def _open(edges: DataFrame) -> int:
    """Nodes that hang on two others, or hang on one and have others hang on them."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    by = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by.where("up > 1 or (up = 1 and down = 1)").count()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node of an edge; root is the least node of its component."""
    least, most = F.least(a, b), F.greatest(a, b)
    now = written(edges.where(F.col(a) != F.col(b)).select(most.alias("u"), least.alias("v")).distinct(), "edges")
    while _open(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = written(both.groupBy("u").agg(F.min("v").alias("m")), "near")
        # large star: larger neighbours of u hang on u's least neighbour (or on u)
        large = written(both.join(near, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        # small star: smaller neighbours of u, and u, hang on the least of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = written(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        for old in (now, near, large, low):
            drop(old)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
