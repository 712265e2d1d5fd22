"""Texts as chunks that a byte-level tokenizer encodes one by one, and a memo for them.

The tokenizer's pattern never joins what stands on both sides of the last blank of
a run of white space that a word follows.  So a text may be cut before that blank,
and the ids of the text are the ids of its chunks, joined.  Chunks repeat, so each
distinct one is encoded once and looked up afterwards by two independent 64-bit hashes.

Texts for which that might not hold, those with an added token's string or with
white space beyond ASCII's, stay one chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textcore import IS_SPACE, Block, offsets_of, ragged, segment_sum

# First bytes of the UTF-8 forms of white space beyond ASCII, with the second bytes that matter.
_RARE = [(0xC2, {0x85, 0xA0}), (0xE1, {0x9A}), (0xE2, {0x80, 0x81}), (0xE3, {0x80})]


def odd_documents(blk: Block, added: list[bytes]) -> np.ndarray:
    """Documents that must not be cut."""
    d = blk.data
    at = [np.flatnonzero((d >= 0x1C) & (d <= 0x1F))]
    for lead, second in _RARE:
        p = np.flatnonzero(d[:-1] == lead)
        at.append(p[np.isin(d[p + 1], list(second))])
    raw = d.tobytes()
    for s in added:
        p = raw.find(s)
        found = []
        while p >= 0:
            found.append(p)
            p = raw.find(s, p + 1)
        at.append(np.array(found, np.int64))
    out = np.zeros(blk.n, bool)
    out[np.searchsorted(blk.doc_start, np.concatenate(at), "right") - 1] = True
    return out


def chunks(blk: Block, added: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of chunks, and each document's first chunk (n+1)."""
    s, _, first = blk.words()
    doc = np.repeat(np.arange(blk.n), np.diff(first))
    at = np.maximum(s - 1, blk.doc_start[doc])
    blk.odd = odd_documents(blk, added)
    at = at[~blk.odd[doc]]
    live = blk.doc_end > blk.doc_start
    cut = np.zeros(len(blk.data), bool)
    cut[at] = True
    cut[blk.doc_start[live]] = True
    at = np.flatnonzero(cut)
    first = np.append(np.searchsorted(at, blk.doc_start), len(at))
    ends = np.append(at[1:], len(blk.data))
    last = first[1:][live] - 1
    ends[last] = blk.doc_end[live]
    return at, ends, first


def joinable(blk: Block, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Chunks of one blank and a word, which may be encoded as one text with others like them."""
    two = (e - s >= 2) & ~blk.odd[np.searchsorted(blk.doc_start, s, "right") - 1]
    nxt = blk.data[np.minimum(s + 1, len(blk.data) - 1)]
    return two & IS_SPACE[blk.data[s]] & ~IS_SPACE[nxt]


class Memo:
    """Ids of chunks by hash; of fixed size, later chunks take the places of earlier ones.

    A chunk is known again by 128 bits, two hashes with seeds of their own.
    """

    def __init__(self, bits: int = 20, room: int = 16 << 20, dtype=np.uint16):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.checks = np.zeros(1 << bits, np.uint64)
        self.starts = np.zeros(1 << bits, np.int64)
        self.lens = np.zeros(1 << bits, np.int32)
        self.store = np.zeros(room, dtype)
        self.used = 0

    def look_up(self, blk: Block, s: np.ndarray, e: np.ndarray, new: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, joined, and how many each has.  new(blk, s, e) gives both for unknown chunks."""
        h, check = blk.hash_spans(s, e), blk.hash_spans(s, e, 1)
        slot = (h >> self.shift).astype(np.int64)
        start, length = self.starts[slot], self.lens[slot]
        miss = np.flatnonzero((self.keys[slot] != h) | (self.checks[slot] != check))
        if len(miss):
            order = np.argsort(h[miss])
            a, b = h[miss][order], check[miss][order]
            new_key = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            one = miss[order[new_key]]
            back = np.empty(len(miss), np.int64)
            back[order] = np.cumsum(new_key) - 1
            ids, lens = new(blk, s[one], e[one])
            if self.used + len(ids) > len(self.store):
                self.keys[:] = 0  # start afresh: known chunks of this block are encoded anew
                self.checks[:] = 0
                self.used = 0
                if len(ids) > len(self.store):
                    self.store = np.zeros(2 * len(ids), self.store.dtype)
                if len(miss) < len(h):
                    return self.look_up(blk, s, e, new)
            at = self.used + offsets_of(lens)[:-1]
            self.store[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.keys[slot[one]], self.checks[slot[one]], self.starts[slot[one]], self.lens[slot[one]] = h[one], check[one], at, lens
            start[miss], length[miss] = at[back], lens[back]
        return self.store[ragged(start, length)], length

    def encode(self, blk: Block, added: list[bytes], new: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block and their bounds by document."""
        s, e, first = chunks(blk, added)
        ids, length = self.look_up(blk, s, e, new)
        return ids, offsets_of(segment_sum(length, first))
