"""MinHash signatures, and streams of sorted groups for Arrow workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textcore import segment_reduce

HASHES = 128
_U = np.uint64
_rng = np.random.default_rng(0xA11CE)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | _U(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
#: Stands in a signature where there is no shingle.
NOTHING = np.uint32(0xFFFFFFFF)


def permuted(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function over 64-bit shingle hashes, 32 bits."""
    return ((h * _MUL[k] + _ADD[k]) >> _U(32)).astype(np.uint32)


def signatures(h: np.ndarray, bounds: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    out = np.empty((len(bounds) - 1, hashes), np.uint32)
    for k in range(hashes):
        out[:, k] = segment_reduce(np.minimum, permuted(h, k), bounds, NOTHING)
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """A fixed number of bytes from each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    flat = np.ascontiguousarray(rows)
    off = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(flat.tobytes())])


def matrix(col: pa.Array, dtype, width: int) -> np.ndarray:
    """The reverse of ``binary``."""
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int32, len(col) + 1, col.offset * 4)
    if not len(col):
        return np.zeros((0, width), dtype)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(dtype).reshape(len(col), width)


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Re-cuts a stream that is sorted by ``key`` so that no group lies in two tables."""
    held: list[pa.RecordBatch] = []

    def tail_start(t: pa.Table) -> int:
        last = [t.column(k)[-1].as_py() for k in key]
        low, high = 0, t.num_rows - 1  # the stream is sorted: halve to the last group's first row
        while low < high:
            mid = (low + high) // 2
            if [t.column(k)[mid].as_py() for k in key] == last:
                high = mid
            else:
                low = mid + 1
        return low

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held).combine_chunks()
        if (at := tail_start(t)) > 0:
            yield t.slice(0, at)
            held = t.slice(at).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(t: pa.Table, key: list[str]) -> np.ndarray:
    """First rows of the groups of a sorted table, and its length."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in key:
        c = t.column(k).combine_chunks()
        if isinstance(c, pa.ChunkedArray):
            c = c.chunk(0)
        if pa.types.is_integer(c.type):
            v = c.to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        else:
            v = c.to_pylist()
            new[1:] |= np.fromiter((x != y for x, y in zip(v[1:], v[:-1], strict=True)), bool, len(v) - 1)
    return np.append(np.flatnonzero(new), t.num_rows)


def linked_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links u-v join it to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, u, root[v])
        np.minimum.at(root, v, root[u])
        root = root[root]
        if (root == before).all():
            return root
