"""Transactions of a history that no serial order explains: strongly connected components of its conflicts.

A history is a table (txn, op, k, seq): who read (``r``) or wrote (``w``) which key, and when.  Two
operations of one key conflict if one is a write; the earlier must come first.  A transaction
is in a cycle if it must come before another one and after it.

No conflicts are listed.  Of a key a transaction needs two numbers only: ``lo``, from where on others
must come after it (behind its first write, or at the first write behind its first read), and ``hi``, up
to where others must come before it.  It leads to all whose ``hi`` is its ``lo`` at least, so there is
one row for each transaction and key, whatever the operations.

1. Cut: no cycle crosses a moment that no transaction lasts over, nor one that nothing leads back
   over.  Stretches between those are groups of their own.  They are exact: a grid of ``GRID`` cells
   for each group gives what is open where a cell begins, and a window finds the rest within it.
2. Groups of ``ROWS`` rows at most are solved by the bundle, each bundle in one task, by depth-first search.
3. Larger ones are dealt out by time into slices of about so many rows.  What is a component within a slice
   is part of one of the group, so it goes on as a single transaction, and the group starts anew.
4. If that doesn't shrink them: reach from a pivot of each group, forward and backward together, all
   groups side by side, as thresholds for each key.  What the pivot reaches and what reaches it
   is a component; the rest goes on as the groups of what only one of both has met, or neither.

A round takes at least the pivot from every group.  Rows with a null count for nothing; repeated
ones count once.  (To find the write behind a read, the operations of one key are put in order by one task.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import file_system, new_path

#: Cells of a group, over which its stretches are found.
GRID = 1024
#: Rows of a group that one task solves, of a bundle of smaller ones, and of a slice of larger ones, about.
ROWS = 1 << 17
#: What goes on after slices are solved, at most; if more is left, pivots come next.
SHRUNK = 0.7
_NEVER = (1 << 63) - 1
_ROW = "g bigint, t string, many boolean, k string, lo bigint, hi bigint, first bigint, last bigint"


class _Rounds:
    """Tables of the rounds, each a folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.made = spark, new_path(spark, "cycles"), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            fs, p = file_system(self.spark, t.path)
            fs.delete(p, True)


def conflicts(history: DataFrame) -> DataFrame:
    """g, t, many, k, lo, hi, first, last: where a transaction's conflicts of a key begin and end, and how long it lasts."""
    ops = history.select(F.col("txn").cast("string").alias("t"), "op", F.col("k").cast("string").alias("k"), F.col("seq").cast("bigint").alias("seq")).na.drop()
    behind = Window.partitionBy("k").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    write, at = F.col("op") == "w", F.col("seq")
    ops = ops.withColumn("behind", F.min(F.when(write, at)).over(behind))
    # even: at a write; odd: between writes
    ops = ops.where(F.col("op").isin("r", "w")).select("t", "k", "seq", F.when(write, at * 2 + 1).otherwise(F.coalesce(F.col("behind") * 2, F.lit(_NEVER))).alias("lo"), F.when(write, at * 2).otherwise(at * 2 - 1).alias("hi"))
    rows = ops.groupBy("t", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    whole = Window.partitionBy("t")
    return rows.select(F.lit(0).cast("bigint").alias("g"), "t", F.lit(False).alias("many"), "k", "lo", "hi", F.min("first").over(whole).alias("first"), F.max("last").over(whole).alias("last"))


def _led_back(rows: DataFrame) -> DataFrame:
    """g, t, low, high: from the end of each transaction back to the first end that it leads to."""
    upward = Window.partitionBy("g", "k").orderBy(F.desc("at"), F.desc("side"))
    both = rows.select("g", "k", F.col("hi").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("t"), "last").unionAll(rows.select("g", "k", "lo", F.lit(0), "t", "last"))
    least = both.withColumn("low", F.min(F.when(F.col("side") == 1, F.col("last"))).over(upward)).where("side = 0")
    return least.groupBy("g", "t").agg(F.least(F.min("low"), F.max("last")).alias("low"), F.max("last").alias("high"))


def _cut(spans: DataFrame, grid: int) -> DataFrame:
    """g, t, to: stretches that spans (g, t, low, high) cover without a gap; each is a group."""
    size = spans.groupBy("g").agg(F.min("low").alias("from"), F.max("high").alias("upto"))
    ends = spans.select("g", F.col("low").alias("p"), F.lit(1).alias("n"), "t").unionAll(spans.select("g", "high", F.lit(-1), F.lit(None).cast("string")))
    cell = F.floor((F.col("p") - F.col("from")) * float(grid) / (F.col("upto") - F.col("from") + 1)).cast("int")
    ends = ends.join(size, "g").select("g", "p", "n", "t", cell.alias("c"))
    before = Window.partitionBy("g").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)  # at most grid + 1 rows for each group
    open_ = ends.groupBy("g", "c").agg(F.sum("n").alias("n")).select("g", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("open"))
    inside = Window.partitionBy("g", "c").orderBy("p", F.desc("n"))
    within = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = ends.join(open_, ["g", "c"]).withColumn("new", F.when(F.col("open") + within == 0, F.col("p")))
    marks = marks.withColumn("run", F.max("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marks.groupBy("g", "c").agg(F.max("new").alias("new")).select("g", "c", F.max("new").over(before).alias("earlier"))
    return marks.where("n = 1").join(runs, ["g", "c"]).select("g", "t", F.xxhash64("g", F.coalesce("run", "earlier")).alias("to"))


def _components(first: list[int], to: list[int]) -> list[int]:
    """Strongly connected components: a number for each node; node v leads to to[first[v] : first[v + 1]]."""
    n = len(first) - 1
    at, number, low, out = first[:-1], [0] * n, [0] * n, [-1] * n
    stack, count, made = [], 0, 0
    for root in range(n):
        path = [] if number[root] else [root]
        while path:
            v = path[-1]
            i = at[v]
            if not number[v]:
                count += 1
                number[v] = low[v] = count
                stack.append(v)
            if i < first[v + 1]:
                at[v], w = i + 1, to[i]
                if not number[w]:
                    path.append(w)
                elif out[w] < 0 and number[w] < low[v]:
                    low[v] = number[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == number[v]:
                while out[v] < 0:
                    out[stack.pop()] = made
                made += 1
    return out


def _codes(*cols: pa.ChunkedArray) -> np.ndarray:
    """A number for each different combination."""
    out = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        c = pc.dictionary_encode(c).combine_chunks()
        out = np.unique(out * (len(c.dictionary) + 1) + c.indices.to_numpy(), return_inverse=True)[1]
    return out


def _solved(rows: pa.Table) -> pa.Table:
    """Rows of each component as those of one transaction; and, without a key, transactions that turn out to be in cycles."""
    g, t = rows.column("g"), rows.column("t")
    one, line = _codes(g, t), _codes(g, rows.column("k"))
    lo, hi, first, last = (rows.column(c).to_numpy() for c in ("lo", "hi", "first", "last"))
    n, m = int(one.max()) + 1, len(one)
    place = np.unique(np.concatenate([hi, lo]), return_inverse=True)[1] + line[np.arange(2 * m) % m] * (2 * m)
    order = np.argsort(place[:m], kind="stable")
    start = np.searchsorted(place[:m][order], place[m:])
    leads = (start < m) & (line[order[np.minimum(start, m - 1)]] == line)
    # nodes: transactions, then the rows in order; a row leads to its transaction and the next row of its key
    next_ = np.flatnonzero(line[order[1:]] == line[order[:-1]])
    a = np.concatenate([one[leads], n + np.arange(m), n + next_])
    b = np.concatenate([n + start[leads], one[order], n + next_ + 1])[np.argsort(a, kind="stable")]
    heads = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n + m))])
    part = np.unique(_components(heads.tolist(), b.tolist())[:n], return_inverse=True)[1]

    many = np.zeros(n, bool)
    many[one] = rows.column("many").to_numpy()
    of = np.zeros(n, np.int64)
    of[one] = np.arange(m)  # a row of each transaction
    size = np.bincount(part)
    found = of[(size[part] > 1) & ~many]
    lead = np.full(len(size), m)
    np.minimum.at(lead, part[one], np.arange(m))
    whole, begin, end = size > 1, np.full(len(size), _NEVER), np.full(len(size), -_NEVER)
    whole[part] |= many
    mine = part[one]
    np.minimum.at(begin, mine, first)
    np.maximum.at(end, mine, last)
    both, at, back = np.unique(mine * (m + 1) + line, return_index=True, return_inverse=True)
    low, high = np.full(len(both), _NEVER), np.full(len(both), -_NEVER)
    np.minimum.at(low, back, lo)
    np.maximum.at(high, back, hi)
    p = mine[at]
    on = pa.table([g.take(lead[p]), t.take(lead[p]), pa.array(whole[p]), rows.column("k").take(at), pa.array(low), pa.array(high), pa.array(begin[p]), pa.array(end[p])], names=["g", "t", "many", "k", "lo", "hi", "first", "last"])
    out = rows.take(found).select(on.column_names)
    return pa.concat_tables([on, out.set_column(3, "k", pa.nulls(len(found), pa.string()))])


def _met(rounds: _Rounds, rows: DataFrame) -> DataFrame:
    """g, t, f, b: what each group's pivot reaches, and what reaches it."""
    pivots = rows.groupBy("g").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    ways = rows.select("g", F.lit("f").alias("way"), "t", "k", F.col("hi").alias("enter"), F.col("lo").alias("leave")).unionAll(rows.select("g", F.lit("b"), "t", "k", -F.col("lo"), -F.col("hi")))
    met = rounds.written(pivots.select("g", F.explode(F.array(F.lit("f"), F.lit("b"))).alias("way"), "t"))
    known = -1
    while (n := met.count()) > known:
        known, old = n, met
        most = ways.join(met, ["g", "way", "t"]).groupBy("g", "way", "k").agg(F.min("leave").alias("x"))
        reached = ways.join(most, ["g", "way", "k"]).where("enter >= x").select("g", "way", "t")
        met = rounds.written(reached.unionAll(met).distinct())
        rounds.drop(old)
    return met.groupBy("g", "t").agg(F.bool_or(F.col("way") == "f").alias("f"), F.bool_or(F.col("way") == "b").alias("b"))


def in_cycles(history: DataFrame, grid: int = GRID) -> DataFrame:
    """txn of every transaction that is in a cycle."""
    spark = history.sparkSession
    rounds, found, cols = _Rounds(spark), [], ["g", "t", "many", "k", "lo", "hi", "first", "last"]

    def grouped(rows: DataFrame, to: DataFrame) -> DataFrame:
        """Rows in their new groups, without groups of one; and the rows of the group."""
        to = to.withColumn("ones", F.count("*").over(Window.partitionBy("to"))).where("ones > 1")
        return rows.join(to, ["g", "t"]).select(F.col("to").alias("g"), *cols[1:])

    def sized(rows: DataFrame) -> DataFrame:
        return rounds.written(rows.join(rows.groupBy("g").agg(F.count("*").alias("size")), "g"))

    def small_solved(rows: DataFrame) -> DataFrame:
        """The larger groups; those of ROWS rows at most are settled."""
        n = rows.where(F.col("size") <= ROWS).count()
        if n:
            bundle = F.pmod(F.xxhash64(F.col("g"), F.lit(1)), F.lit(-(-n // ROWS) * 2)).alias("bundle")
            solved = rows.where(F.col("size") <= ROWS).select(bundle, *cols).groupBy("bundle").applyInArrow(_solved, _ROW)
            found.append(rounds.written(solved.where("k is null").select(F.col("t").alias("txn"))))
        return rows.where(F.col("size") > ROWS).select(*cols)

    rows = rounds.written(conflicts(history))
    spans = lambda: rows.select("g", "t", F.col("first").alias("low"), F.col("last").alias("high")).distinct()
    stretches = spans()
    while True:
        cut = sized(grouped(rows, _cut(stretches, grid)))
        rounds.drop(rows)
        rows = small_solved(cut)
        if rows.isEmpty():
            break
        tight = sized(grouped(rows, _cut(_led_back(rows), grid)))
        rounds.drop(cut)
        rows = small_solved(tight)
        n = rows.count()
        if not n:
            break
        slices = rounds.written(rows.repartitionByRange(-(-2 * n // ROWS), "g", "last", "t").withColumn("slice", F.spark_partition_id()))
        solved = rounds.written(slices.groupBy("g", "slice").applyInArrow(_solved, _ROW))
        rounds.drop(tight, slices)
        found.append(rounds.written(solved.where("k is null").select(F.col("t").alias("txn"))))
        rows = rounds.written(solved.where("k is not null"))
        rounds.drop(solved)
        if rows.count() > SHRUNK * n:
            met = rounds.written(_met(rounds, rows))
            none = F.coalesce("f", F.lit(False)), F.coalesce("b", F.lit(False))
            marked = rounds.written(rows.join(met, ["g", "t"], "left").select(*cols, none[0].alias("f"), none[1].alias("b")))
            ones = marked.where("f and b").select("g", "t", "many").distinct()
            ones = ones.join(ones.groupBy("g").agg(F.count("*").alias("size")).where("size > 1"), "g", "left_semi")
            found.append(rounds.written(ones.where("not many").select(F.col("t").alias("txn"))))
            rounds.drop(rows, met)
            rows = rounds.written(marked.where("not (f and b)").select(F.xxhash64("g", "f", "b").alias("g"), *cols[1:]))
            rounds.drop(marked)
        stretches = spans()
    out = spark.createDataFrame([], "txn string")
    for f in found:
        out = out.unionAll(f)
    return out
