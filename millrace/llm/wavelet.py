"""Wavelet matrix: a sequence of ids as bit planes with rank and select.

File format, little-endian: 8 bytes magic; u32 n, u32 bits, u32 documents, u32 0;
bits x u64 zeros of each plane; for each plane from the highest bit its packed bits
(padded to 64) and a u32 rank sample for every 512 bits, by which
select finds the sample of an occurrence; i64 document ids; u8 whether
a document id is null (padded to 8); u64 document ends.  A plane costs 1/16 more than
its bits, so an id costs 1.06 x bits, wherever it stands.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"MRWAVE1\0"
SAMPLE = 512


def _pad(n: int, to: int = 8) -> int:
    return -(-n // to) * to


def encode(ids: np.ndarray, bits: int, doc_ids: list, ends: np.ndarray) -> bytes:
    n = len(ids)
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, planes = [], []
    for p in range(bits - 1, -1, -1):
        bit = (cur >> cur.dtype.type(p)) & cur.dtype.type(1) != 0
        packed = np.zeros(_pad(-(-n // 8)), np.uint8)
        packed[: -(-n // 8)] = np.packbits(bit, bitorder="little")
        whole = np.zeros(_pad(n, SAMPLE), np.uint8)
        whole[:n] = bit
        rank = np.zeros(_pad(len(whole) // SAMPLE + 1, 2), np.uint32)
        rank[1 : len(whole) // SAMPLE + 1] = np.cumsum(whole.reshape(-1, SAMPLE).sum(1, dtype=np.uint32))
        planes += [packed.tobytes(), rank.tobytes()]
        low = cur[~bit]
        zeros.append(len(low))
        cur = np.concatenate([low, cur[bit]])
    nulls = np.zeros(_pad(len(doc_ids)), np.uint8)
    nulls[: len(doc_ids)] = [d is None for d in doc_ids]
    head = np.array([n, bits, len(doc_ids), 0], "<u4")
    own = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), np.array(zeros, "<u8").tobytes(), *planes, own.tobytes(), nulls.tobytes(), np.asarray(ends, "<u8").tobytes()])


class WaveletMatrix:
    """Reads the format from bytes or a memory map; nothing is unpacked until asked for."""

    def __init__(self, buf):
        raw = np.frombuffer(buf, np.uint8)
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, self.bits, docs, _ = (int(v) for v in raw[8:24].view("<u4"))
        at = 24

        def take(count: int, dtype: str) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(dtype).itemsize
            out = raw[at : at + size].view(dtype)
            at += size
            return out

        self.zeros = take(self.bits, "<u8").astype(np.int64)
        self.planes, self.ranks = [], []
        for _ in range(self.bits):
            self.planes.append(take(_pad(-(-self.n // 8)), "u1"))
            self.ranks.append(take(_pad(_pad(self.n, SAMPLE) // SAMPLE + 1, 2), "<u4"))
        ids, nulls = take(docs, "<i8"), take(_pad(docs), "u1")[:docs]
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
        self.ends = take(docs, "<u8").astype(np.int64)

    def _bit(self, p: int, i: np.ndarray) -> np.ndarray:
        return (self.planes[p][i >> 3] >> (i & 7).astype(np.uint8)) & 1

    def _rank1(self, p: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane p before place i."""
        base = i // SAMPLE
        out = self.ranks[p][base].astype(np.int64)
        left = i - base * SAMPLE
        bytes_ = self.planes[p]
        for k in range(SAMPLE // 8):
            live = left > 8 * k
            if not live.any():
                break
            at = base[live] * (SAMPLE // 8) + k
            keep = np.minimum(left[live] - 8 * k, 8)
            out[live] += np.bitwise_count(bytes_[at] & ((1 << keep) - 1).astype(np.uint8))
        return out

    def access(self, at) -> np.ndarray:
        i = np.atleast_1d(np.asarray(at, np.int64)).copy()
        out = np.zeros(len(i), np.int64)
        for p in range(self.bits):
            bit = self._bit(p, i).astype(bool)
            one = self._rank1(p, i)
            out = out << 1 | bit
            i = np.where(bit, self.zeros[p] + one, i - one)
        return out

    def _range(self, value: int, end: int) -> tuple[int, int]:
        a, z = np.array([0]), np.array([end])
        for p in range(self.bits):
            one = value >> (self.bits - 1 - p) & 1
            ra, rz = self._rank1(p, a), self._rank1(p, z)
            a, z = (self.zeros[p] + ra, self.zeros[p] + rz) if one else (a - ra, z - rz)
        return int(a[0]), int(z[0])

    def rank(self, value: int, end: int) -> int:
        """Occurrences of an id before a place."""
        a, z = self._range(value, end)
        return z - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k) -> np.ndarray:
        """Places of the k-th occurrences (from 0) of an id."""
        a, z = self._range(value, self.n)
        i = a + np.atleast_1d(np.asarray(k, np.int64))
        if len(i) and (i.min() < a or i.max() >= z):
            raise IndexError("no such occurrence")
        for p in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - p) & 1
            i = self._select(p, i - (self.zeros[p] if one else 0), one)
        return i

    def _select(self, p: int, k: np.ndarray, one: int) -> np.ndarray:
        """Places of the k-th ones or zeros of plane p: the sample before each by halving, then the bits of one sample."""
        rank = self.ranks[p][: _pad(self.n, SAMPLE) // SAMPLE + 1].astype(np.int64)
        before = rank if one else np.arange(len(rank)) * SAMPLE - rank
        block = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 1 << 12):  # so many samples are unpacked at once
            own = block[a : a + (1 << 12)]
            at = own[:, None] * (SAMPLE // 8) + np.arange(SAMPLE // 8)
            raw = self.planes[p][np.minimum(at, len(self.planes[p]) - 1)]
            bits = np.unpackbits(raw, axis=1, bitorder="little") == one
            left = k[a : a + (1 << 12)] - before[own]
            out[a : a + (1 << 12)] = own * SAMPLE + (np.cumsum(bits, axis=1) > left[:, None]).argmax(1)
        return out

    def occurrences(self, value: int) -> np.ndarray:
        return self.select(value, np.arange(self.count(value)))

    def tokens(self) -> np.ndarray:
        """The whole sequence, put together from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[p], bitorder="little")[: self.n].view(bool)
            up = np.empty(self.n, kind)
            z = self.zeros[p]
            up[~bit] = cur[:z]
            up[bit] = cur[z:] | kind(1 << (self.bits - 1 - p))
            cur = up
        return cur
