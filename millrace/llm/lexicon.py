"""Minimal acyclic transducer: frequent words with their ids in a shared-suffix automaton.

Words are added in order and every finished state is replaced by an equal one that is
there already, so suffixes are shared and the automaton is minimal.  A state knows how
many words it accepts, so the way of a word through it sums up to the word's number,
and the output table is indexed by that.  The image is one flat byte string, edges by
open addressing, that is mapped into memory; all words of a batch walk through it in step.
"""

from __future__ import annotations

import numpy as np

from .bpe import PairTable
from .textcore import offsets_of, ragged


def build(words: list[bytes], ids: np.ndarray, lens: np.ndarray) -> bytes:
    """Image of a lexicon; words sorted and distinct, ids[sum(lens)] their outputs."""
    edges: list[list[tuple[int, int]]] = [[]]  # of each state: (byte, target)
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]
    before = b""

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            child = path.pop()
            key = (final[child], *edges[child])
            same = known.setdefault(key, child)
            if same != child:
                byte, _ = edges[path[-1]][-1]
                edges[path[-1]][-1] = (byte, same)
                edges[child] = []

    for w in words:
        common = next((k for k, (x, y) in enumerate(zip(w, before, strict=False)) if x != y), min(len(w), len(before)))
        close(common)
        for byte in w[common:]:
            edges.append([])
            final.append(False)
            edges[path[-1]].append((byte, len(edges) - 1))
            path.append(len(edges) - 1)
        final[path[-1]] = True
        before = w
    close(0)

    number: dict[int, int] = {}
    accepts: dict[int, int] = {}
    stack = [(0, False)]
    while stack:  # children before their parents
        s, ready = stack.pop()
        if s in accepts:
            continue
        if ready:
            accepts[s] = final[s] + sum(accepts[t] for _, t in edges[s])
        else:
            stack.append((s, True))
            stack += [(t, False) for _, t in edges[s]]
    for s in accepts:
        number.setdefault(s, len(number))
    rows = []
    ends = np.zeros(len(number), np.int64)
    for s, n in number.items():
        ends[n] = final[s]
        skip = int(final[s])
        for byte, t in edges[s]:
            rows.append((n << 8 | byte, number[t], skip))
            skip += accepts[t]
    table = np.array(rows, np.int64).reshape(-1, 3)
    edges_of = PairTable(table[:, 0] >> 8, table[:, 0] & 255, table[:, 2].astype(np.int32), table[:, 1].astype(np.int32))
    head = np.array([len(edges_of.keys), edges_of.steps, len(number), number[0], len(words), len(ids), max(map(len, words), default=0)], np.int64)
    parts = (edges_of.keys.astype("<u8"), edges_of.rank.astype("<i4"), edges_of.made.astype("<i4"), ends.astype("<i8"), offsets_of(lens).astype("<i8"), ids.astype("<i8"))
    return b"".join(x.tobytes() for x in (head.astype("<i8"), *parts))


class Lexicon:
    """The automaton over an image: bytes, or the path of a file that is mapped."""

    def __init__(self, image: bytes | str):
        raw = np.memmap(image, np.uint8, "r") if isinstance(image, str) else np.frombuffer(image, np.uint8)
        slots, steps, states, self.root, words, total, self.longest = (int(v) for v in raw[:56].view("<i8"))
        at = 56

        def take(count: int, dtype: str) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(dtype).itemsize
            at += size
            return np.asarray(raw[at - size : at].view(dtype))

        keys, skip, target = take(slots, "<u8"), take(slots, "<i4"), take(slots, "<i4")
        self.edges = PairTable.over(keys, skip, target, steps)
        self.final, self.bounds, self.ids = take(states, "<i8"), take(words + 1, "<i8"), take(total, "<i8")
        self.states = states

    def find(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Numbers of words given by their bytes; -1 if the lexicon lacks one."""
        out = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero(lens <= self.longest) if self.longest else np.zeros(0, np.int64)
        at, end = starts[live], starts[live] + lens[live]
        state, number = np.full(len(live), self.root, np.int32), np.zeros(len(live), np.int32)
        none = np.iinfo(np.int32).max
        while len(live):
            skip, state = self.edges.find(state, data[at])
            at = at + 1
            number = number + skip  # of use only where there is an edge
            on = skip != none
            done = np.flatnonzero(on & (at == end))
            done = done[self.final[state[done]] == 1]
            out[live[done]] = number[done]
            go = np.flatnonzero(on & (at < end))
            live, at, end, number, state = live[go], at[go], end[go], number[go], state[go]
        return out

    def outputs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.bounds[numbers + 1] - self.bounds[numbers]
        return self.ids[ragged(np.asarray(self.bounds[numbers]), lens)], lens
