"""Nearest vectors: a set of queries against all rows, exact, by cells that can be passed over.

Rows lie in cells around centres that are fitted on ``SAMPLE`` rows at most; every row is in the
cell of its nearest centre, and a cell knows its radius r, the greatest distance of a row of it.
No row of a cell around c scores more against a query q than q . c + |q| r (for the cosine, of
vectors of length 1), so a cell whose bound is below the k-th best score that a query has already
can't change its result:

1. each query looks at the cells of highest bound that have k rows together,
2. then at all whose bound reaches the k-th best score found there.

Nothing else is passed over, so the result is that of all rows.  Rows of a cell are packed, a part of
it to a row of a table, and so are queries that are near each other, a block to a row.  Blocks meet the parts
that they want in a Cartesian product, which reads both tables again and shuffles neither; a
task has one block at a time, scores it against the parts of its partition as matrix products, and
gives k rows at most for each query when the block ends.  A window ranks those.  How much is passed
over depends on the data: evenly spread vectors of many dimensions have no cells worth the name, and
then all rows are met; what is written still is no more than both tables and k rows for each query and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_path

#: Rows that centres are fitted on, and centres, at most; rows for each centre, about.
SAMPLE, CENTRES, CELL_ROWS = 1 << 15, 4096, 2048
#: Rows of a part of a cell, and queries of a block, at most; bytes of either's vectors (of one vector at least).
PART_ROWS, BLOCK_QUERIES, PACK_BYTES = 8192, 4096, 1 << 19
#: Places after the point to which scores are compared, so that two ways to sum rank alike.
PLACES = 9
#: Bytes of an Arrow batch, about.
ARROW_BYTES = 1 << 23
_SLACK = 10.0**-PLACES


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of that many numbers, none null, as a matrix; and their rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    whole = np.array([v is not None and len(v) == dim and None not in v for v in col.to_pylist()], bool) if col.null_count or col.values.null_count else np.asarray(col.value_lengths()) == dim
    at = np.flatnonzero(whole)
    flat = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(at), dim), at


def _prepared(col: pa.Array, dim: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    x, at = _matrix(col, dim)
    return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300) if metric == "cosine" else x), at


def _binary(x: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    step = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * step), pa.py_buffer(np.ascontiguousarray(x))])


def _stacked(col: pa.Array, dim: int) -> np.ndarray:
    """The matrix of such rows."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None], 0)


def fit_centres(x: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds from rows at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([_squares(x[a : a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Cells:
    """What is known of each cell; workers get it."""

    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    metric: str

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest score that each query could have in each cell; -inf for cells without rows."""
        at = q @ self.centres.T + np.sqrt((q * q).sum(1))[:, None] * self.radius[None]
        return np.where(self.count > 0, at + _SLACK * (1 + np.abs(at)), -np.inf)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Which cells a query looks at first: those of highest bound until they have more than k rows."""
        order = np.argsort(-bounds, 1, kind="stable")
        rows = np.cumsum(self.count[order], 1)
        take = np.concatenate([np.ones((len(order), 1), bool), rows[:, :-1] <= k], 1)
        out = np.zeros_like(take)
        np.put_along_axis(out, order, take, 1)
        return out & (bounds > -np.inf)


def _written(df: DataFrame, label: str, **options: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Packs are read as they lie, so that the size of a file tells what a task holds.
_PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def cells(rows: DataFrame, id_col: str, vector: str, dim: int, metric: str = "cosine") -> tuple[Cells, DataFrame]:
    """Cells, and the rows with vectors of ``dim`` numbers packed by cell (written): cell, n, ids, vectors, far."""
    slim = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") == dim))
    total = slim.count()
    h = F.pmod(F.xxhash64("vector"), F.lit(1 << 30))
    near = slim.where(h < int((1 << 30) * min(1.0, 2.0 * SAMPLE / max(total, 1)))).select("vector").orderBy(h).limit(SAMPLE) if total > SAMPLE else slim.select("vector")
    sample, _ = _prepared(near.toArrow().column("vector"), dim, metric)  # SAMPLE rows at most
    centres = fit_centres(sample, min(CENTRES, max(1, total // CELL_ROWS))) if len(sample) else np.zeros((1, dim))
    most = max(1, min(PART_ROWS, PACK_BYTES // (8 * dim)))

    def assign(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x, at = _prepared(b.column("vector"), dim, metric)
            for a in range(0, len(at), 4096):
                y = x[a : a + 4096]
                own = _squares(y, centres).argmin(1)
                far = np.sqrt(((y - centres[own]) ** 2).sum(1))
                yield pa.record_batch([pa.array(own.astype(np.int32)), b.column("id").take(pa.array(at[a : a + 4096])), _binary(y), pa.array(far)], names=["cell", "id", "vector", "far"])

    def pack(batches: Iterator[pa.RecordBatch]):
        held, n, of = [], 0, -1

        def out():
            t = pa.concat_tables(held)
            return pa.record_batch([pa.array([of], pa.int32()), pa.array([n], pa.int32()), pa.array([t.column("id").to_numpy().tobytes()]), pa.array([b"".join(t.column("vector").to_pylist())]), pa.array([t.column("far").to_numpy().max()])], names=["cell", "n", "ids", "vectors", "far"])

        for b in batches:
            cell, a = b.column("cell").to_numpy(), 0
            ends = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
            while a < len(cell):
                if n and (cell[a] != of or n == most):
                    yield out()
                    held, n = [], 0
                of = int(cell[a])
                upto = min(int(ends[np.searchsorted(ends, a, "right")]), a + most - n)
                held.append(pa.Table.from_batches([b.slice(a, upto - a)]))
                n, a = n + upto - a, upto
        if n:
            yield out()

    placed = slim.mapInArrow(assign, "cell int, id bigint, vector binary, far double").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    packed = _written(placed.mapInArrow(pack, "cell int, n int, ids binary, vectors binary, far double"), "cells", **_PLAIN)
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in packed.groupBy("cell").agg(F.max("far").alias("far"), F.sum("n").alias("n")).collect():  # CENTRES at most
        radius[r["cell"]], count[r["cell"]] = r["far"], r["n"]
    return Cells(centres, radius, count, metric), packed


def _wanted(of: Cells, x: np.ndarray, least: np.ndarray, k: int, first: bool) -> np.ndarray:
    """Which cells each query looks at."""
    out = np.zeros((len(x), len(of.centres)), bool)
    for a in range(0, len(x), 512):
        bounds = of.bounds(x[a : a + 512])
        out[a : a + 512] = of.first(bounds, k) if first else (bounds >= _below(least[a : a + 512, None])) & (bounds > -np.inf)
    return out


def _below(score: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(score), score - _SLACK * (1 + np.abs(np.where(np.isfinite(score), score, 0))), score)


def _blocks(of: Cells, queries: DataFrame, k: int, first: bool) -> DataFrame:
    """Queries (own, id, vector, least) packed (written): ids, vectors, leasts, cells that some query wants, pairs that will be scored."""
    dim = of.centres.shape[1]
    most = max(1, min(BLOCK_QUERIES, 2 * PACK_BYTES // (8 * dim)))

    def pack(batches: Iterator[pa.RecordBatch]):
        held = None

        def out(t: pa.Table):
            x, least = _stacked(t.column("vector"), dim), t.column("least").to_numpy()
            want = _wanted(of, x, least, k, first)
            cols = [pa.array([v.tobytes()]) for v in (t.column("id").to_numpy(), x, least)]
            near = pa.array([np.flatnonzero(want.any(0)).astype(np.int32)], pa.list_(pa.int32()))
            return pa.record_batch([*cols, near, pa.array([int((want @ of.count).sum())])], names=["ids", "vectors", "leasts", "cells", "scored"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= most:
                yield out(held.slice(0, most))
                held = held.slice(most)
        if held is not None and held.num_rows:
            yield out(held)

    near = queries.repartitionByRange("own", "id").sortWithinPartitions("own", "id").select("id", "vector", "least")
    return _written(near.mapInArrow(pack, "ids binary, vectors binary, leasts binary, cells array<int>, scored bigint"), "blocks", **_PLAIN)


class _Best:
    """The k best rows of each query of a block so far."""

    def __init__(self, of: Cells, ids: bytes, vectors: bytes, leasts: bytes, k: int, first: bool):
        self.ids, self.least, self.k = np.frombuffer(ids, np.int64), np.frombuffer(leasts, np.float64).copy(), k
        self.x = np.frombuffer(vectors, np.float64).reshape(len(self.ids), -1)
        self.want, self.order, self.held = _wanted(of, self.x, self.least, k, first), np.argsort(self.ids), []

    def meet(self, cell: int, ids: np.ndarray, x: np.ndarray) -> None:
        me = np.flatnonzero(self.want[:, cell])
        if not len(me):
            return
        s = self.x[me] @ x.T
        at = np.searchsorted(self.ids, ids, sorter=self.order)
        own = self.order[np.minimum(at, len(self.ids) - 1)]
        there = np.searchsorted(me, own)
        same = np.flatnonzero((self.ids[own] == ids) & (me[np.minimum(there, len(me) - 1)] == own))
        s[there[same], same] = -np.inf
        least = self.least[me]
        if len(ids) > self.k and not np.isfinite(least).all():
            least = np.maximum(least, np.partition(s, len(ids) - self.k, 1)[:, len(ids) - self.k])
        q, r = np.nonzero((s >= _below(least)[:, None]) & (s > -np.inf))  # ties included
        self.held.append((me[q], ids[r], np.round(s[q, r], PLACES)))
        if sum(len(h[0]) for h in self.held) > 4 * self.k * len(self.ids):
            self.kept()

    def kept(self) -> tuple[np.ndarray, ...]:
        q, ids, score = (np.concatenate([h[c] for h in self.held]) if self.held else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.least[q[rank == self.k - 1]] = score[rank == self.k - 1]
        self.held = [tuple(v[rank < self.k] for v in (q, ids, score))]
        return self.held[0]


def _found(of: Cells, packed: DataFrame, blocks: DataFrame, k: int, first: bool) -> DataFrame:
    """query, id, score: the k best rows of each query among the cells that it looks at, for each task."""

    def product(batches: Iterator[pa.RecordBatch]):
        best = key = None

        def out():
            q, ids, score = best.kept()
            return pa.record_batch([pa.array(best.ids[q]), pa.array(ids), pa.array(score)], names=["query", "id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].as_py()
                if ids != key:
                    if best is not None:
                        yield out()
                    best, key = _Best(of, ids, b.column("vectors")[i].as_py(), b.column("leasts")[i].as_py(), k, first), ids
                row = np.frombuffer(b.column("row_ids")[i].as_py(), np.int64)
                best.meet(b.column("cell")[i].as_py(), row, np.frombuffer(b.column("row_vectors")[i].as_py(), np.float64).reshape(len(row), -1))
        if best is not None:
            yield out()

    parts = packed.select("cell", F.col("ids").alias("row_ids"), F.col("vectors").alias("row_vectors"))
    met = blocks.drop("scored").join(parts.hint("shuffle_replicate_nl"), F.array_contains("cells", F.col("cell"))).drop("cells")
    return met.mapInArrow(product, "query bigint, id bigint, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


class Search:
    """Queries against cells; ``share`` tells which part of all (query, row) pairs was scored."""

    def __init__(self, of: Cells, rows: DataFrame):
        self.of, self.rows, self.blocks = of, rows, []

    def nearest(self, queries: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
        of, dim = self.of, self.of.centres.shape[1]
        limit, conf = "spark.sql.execution.arrow.maxBytesPerBatch", queries.sparkSession.conf
        now = conf.get(limit, None)
        if now is None or not now.isdigit() or int(now) > ARROW_BYTES:
            conf.set(limit, str(ARROW_BYTES))  # a row of the product has three packs; the plan reads this when it runs
        q = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") == dim))
        q = q.groupBy("id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))

        def own(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                x, at = _prepared(b.column("vector"), dim, of.metric)
                if len(at):
                    yield pa.record_batch([pa.array(_squares(x, of.centres).argmin(1).astype(np.int32)), b.column("id").take(pa.array(at)), _binary(x)], names=["own", "id", "vector"])

        q = _written(q.mapInArrow(own, "own int, id bigint, vector binary"), "queries")
        look = _blocks(of, q.withColumn("least", F.lit(float("-inf"))), k, True)
        first = _top(_found(of, self.rows, look, k, True), k)
        least = _written(first.groupBy(F.col("query").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("least")), "least")
        every = _blocks(of, q.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), k, False)
        self.queries, self.blocks = q, [look, every]
        return _top(_found(of, self.rows, every, k, False), k)

    def share(self) -> float:
        """Scored pairs of a query and a row, divided by all of them; what is looked at first is scored twice and counts twice."""
        scored = sum(b.agg(F.sum("scored")).first()[0] or 0 for b in self.blocks)
        return scored / max(self.queries.count() * int(self.of.count.sum()), 1)


def search(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, metric: str = "cosine") -> Search:
    dim = (queries.where(F.col(vector).isNotNull()).select(F.size(vector)).first() or [1])[0]
    return Search(*cells(rows, id_col, vector, max(dim, 1), metric))


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 10, metric: str = "cosine") -> DataFrame:
    """query, rank (from 1), id and score of the k rows nearest to each query, itself left out.

    ``metric``: cosine or dot.  Ties go to the lesser id.  Null vectors, and those of another
    length than the first query's or with nulls, have no neighbours and are none; the
    cosine with a zero vector is 0.  Rows of repeated ids are rows like others; of queries of
    one id one is asked, and a null id asks nothing and is found by none.
    """
    return search(rows, queries, id_col, vector, metric).nearest(queries, id_col, vector, k)
