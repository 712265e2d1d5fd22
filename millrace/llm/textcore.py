"""Vectorised text kernel shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  A block of documents becomes one byte
buffer (UTF-8, one blank after every document) plus document bounds, and all
work on characters, words, lines and shingles is done by NumPy over the whole
block, so the cost per character is a few nanoseconds and memory is bounded by
``BLOCK_BYTES`` (or by one document, if that is longer).

Words are runs of bytes other than space and 0x09-0x0D.  Null texts count as
empty.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 19
#: Arrow batches that workers get, at most.
BATCH_BYTES = 8 << 20
SHINGLE = 5

#: Spans up to this size are hashed side by side, eight bytes a step; longer ones by the library, one by one.
SHORT_SPAN = 64

_U = np.uint64
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _stirred(h: np.ndarray, lane: np.ndarray) -> np.ndarray:
    h = (h ^ lane) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(31)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(29)
    return h


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... (lengths[i] of them), joined."""
    lengths = lengths.astype(np.int64, copy=False)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    step = np.ones(total, np.int64)
    live = lengths > 0
    s, n, e = starts[live].astype(np.int64, copy=False), lengths[live], ends[live]
    if len(s):
        at = e - n
        step[0] = s[0]
        step[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(step)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; 0 where the slice is empty."""
    c = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def segment_reduce(ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """ufunc over values[bounds[i]:bounds[i+1]] along axis 0; ``empty`` for empty slices."""
    out = np.full((len(bounds) - 1, *values.shape[1:]), empty, values.dtype)
    live = bounds[1:] > bounds[:-1]
    if live.any():
        out[live] = ufunc.reduceat(values, bounds[:-1][live], axis=0)
    return out


def text_arrays(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "") if col.null_count else col
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Block:
    """A block of documents as one buffer; ``extra`` holds the other columns."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(offs) - 1
        self.n = n
        buf = np.full(len(data) + n, 0x20, np.uint8)
        shift = np.arange(n + 1)
        self.doc_start = offs[:-1] + shift[:-1]
        self.doc_end = offs[1:] + shift[:-1]
        keep = np.ones(len(buf), bool)
        keep[self.doc_end] = False
        buf[keep] = data
        self.data = buf
        self._words = None
        self._lanes = None

    def with_data(self, data: np.ndarray) -> Block:
        """The same documents with other bytes in the same places."""
        out = Block.__new__(Block)
        out.n, out.doc_start, out.doc_end = self.n, self.doc_start, self.doc_end
        out.data, out._words, out._lanes = data, None, None
        return out

    @property
    def bounds(self) -> np.ndarray:
        """Document i with its blank is data[bounds[i]:bounds[i+1]]."""
        return np.append(self.doc_start, len(self.data))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each document the first word's index (n+1)."""
        if self._words is None:
            w = ~IS_SPACE[self.data]
            edge = np.flatnonzero(np.diff(w.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            s, e = edge[0::2], edge[1::2]
            first = np.append(np.searchsorted(s, self.doc_start), len(s))
            self._words = s, e, first
        return self._words

    def hash_spans(self, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of data[s:e], equal for equal bytes; each seed gives a function of its own.

        Every step is a bijection of what was hashed so far and a multiplication that isn't
        linear in the bytes, so texts of regular make don't collide more often than others.
        """
        if self._lanes is None:
            padded = np.zeros(len(self.data) + 8, np.uint8)
            padded[:-8] = self.data
            self._lanes = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        n = e - s
        h = mix(n.astype(np.uint64) + _U(0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1))
        live, left = np.flatnonzero((n > 0) & (n <= SHORT_SPAN)), None
        if len(live) == len(n):  # the usual case: no span is left out of the first step
            h = _stirred(h, self._lanes[s] & _LANE[np.minimum(n, 8)])
            at, live = 8, np.flatnonzero(n > 8)
        else:
            at = 0
        while len(live):
            left = n[live] - at
            h[live] = _stirred(h[live], self._lanes[s[live] + at] & _LANE[np.minimum(left, 8)])
            at += 8
            live = live[left > 8]
        raw = memoryview(self.data)
        for i in np.flatnonzero(n > SHORT_SPAN):
            h[i] = xxhash.xxh3_64_intdigest(raw[s[i] : e[i]], seed + 1)
        return mix(h)

    def word_hashes(self) -> np.ndarray:
        s, e, _ = self.words()
        return self.hash_spans(s, e)

    def shingles(self, k: int = SHINGLE, short: bool = True, wh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words and their bounds by document (n+1).

        With ``short``, a document of 1 to k-1 words has one shingle of all its words.
        """
        wh = self.word_hashes() if wh is None else wh
        return run_hashes(wh, self.words()[2], k, short)


def run_hashes(wh: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k items within documents given by ``first``; bounds by document."""
    n_words = np.diff(first)
    count = np.maximum(n_words - k + 1, 0)
    if len(wh) >= k:
        m = len(wh) - k + 1
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = (h + wh[j : j + m]) * _U(0xD6E8FEB86659FD93)
            h ^= h >> _U(32)
        h = mix(h + _U(k))
        h = h[ragged(first[:-1], count)]
    else:
        h = np.zeros(0, np.uint64)
    bounds = offsets_of(count)
    if short and ((n_words > 0) & (n_words < k)).any():
        at = np.flatnonzero((n_words > 0) & (n_words < k))
        own = np.zeros(len(at), np.uint64)
        for j in range(k - 1):
            live = n_words[at] > j
            x = (own[live] + wh[first[at[live]] + j]) * _U(0xD6E8FEB86659FD93)
            own[live] = x ^ (x >> _U(32))
        own = mix(own + n_words[at].astype(np.uint64))
        h = np.insert(h, bounds[at], own)
        count[at] = 1
        bounds = offsets_of(count)
    return h, bounds


def distinct_by_segment(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment, and the new bounds."""
    seg = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, seg))
    h, seg = h[order], seg[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])
    h, seg = h[new], seg[new]
    return h, np.searchsorted(seg, np.arange(len(bounds)))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Cuts Arrow batches into blocks of whole documents of about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_arrays(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), Block(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
            at = to


def give_back() -> None:
    """Returns what a task has freed to the system, since a worker stays for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with batches small enough for two workers in a small executor.

    The limit is read when the plan runs, so the session must keep it; one that the caller
    has made smaller stays as it is.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = df.sparkSession
    now = spark.conf.get(limit, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows with the smallest hashes of ``keys``.

    A count first tells below which hash about twice as many rows lie, so no task
    offers more than its share of those however many tasks there are.
    """
    total = rows.count()
    h = F.xxhash64(*keys)
    if total > 4 * n:
        rows = rows.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2.5 * n / total) + 1)
    return rows.orderBy(F.pmod(h, F.lit(1 << 40)), h, *keys).limit(n)
