"""Byte-level BPE in NumPy: all words of a batch are merged side by side."""

from __future__ import annotations

import json

import numpy as np
import regex

from .pretokens import Memo, chunks, joinable
from .textcore import offsets_of, ragged, segment_sum

# Fixed value: the code points of white space.
_SPACE = "".join(regex.escape(chr(c)) for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
# Fixed value: the published pattern of this tokenizer family, with white space spelt out.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_U = np.uint64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in token strings: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Two numbers for each pair of numbers (a merge's rank and id, an edge's words before it and its end) by open addressing, looked up for whole arrays."""

    @staticmethod
    def over(keys: np.ndarray, rank: np.ndarray, made: np.ndarray, steps: int) -> PairTable:
        """A table whose arrays are there already, as in a mapped file."""
        t = PairTable.__new__(PairTable)
        t.keys, t.rank, t.made, t.steps = keys, rank, made, steps
        t.bits, t.mask = len(keys).bit_length() - 1, len(keys) - 1
        return t

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.rank = np.full(1 << self.bits, np.iinfo(np.int32).max, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        key = left.astype(np.uint64) << _U(32) | right.astype(np.uint64)
        todo, step = np.arange(len(key)), 0
        while len(todo):
            at = (self._slot(key[todo]) + step) & self.mask
            free = self.keys[at] == np.iinfo(np.uint64).max
            slot, first = np.unique(at[free], return_index=True)
            won = todo[np.flatnonzero(free)[first]]
            self.keys[slot], self.rank[slot], self.made[slot] = key[won], rank[won], made[won]
            todo = todo[~np.isin(todo, won)]
            step += 1
        self.steps = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (the greatest int32 if there is no merge) and merged id."""
        key = left.astype(np.uint64) << _U(32) | right.astype(np.uint64)
        at = self._slot(key)
        there = self.keys[at]
        other = np.flatnonzero(there != key)
        rank, made = self.rank[at], self.made[at]
        rank[other] = np.iinfo(np.int32).max
        todo = other[there[other] != np.iinfo(np.uint64).max]
        for step in range(1, self.steps):
            if not len(todo):
                break
            p = (at[todo] + step) & self.mask
            ok = self.keys[p] == key[todo]
            rank[todo[ok]], made[todo[ok]] = self.rank[p[ok]], self.made[p[ok]]
            todo = todo[~ok & (self.keys[p] != np.iinfo(np.uint64).max)]
        return rank, made


class BytePairEncoder:
    _kept: dict[str, BytePairEncoder] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        words: list[bytes] = [b""] * self.size
        for s, i in vocab.items():
            words[i] = bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        for s, i in self.added.items():
            words[i] = s.encode()
        self.word_len = np.array([len(w) for w in words], np.int64)
        self.word_at = offsets_of(self.word_len)
        self.word_bytes = np.frombuffer(b"".join(words), np.uint8)
        self.byte_id = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = PairTable(left, right, np.arange(len(merges), dtype=np.int32), made)
        self.added_bytes = [s.encode() for s in self.added]
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.memo = Memo(dtype=np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.lexicon = None
        self.in_lexicon = self.merged = 0

    @classmethod
    def of(cls, path: str) -> BytePairEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def merge(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as joined bytes; how many each has.

        A round merges, in every word, all occurrences of its lowest-ranked pair from
        left to right, which is what merging one by one comes to.
        """
        sym = self.byte_id[data]
        word = np.repeat(np.arange(len(lens)), lens)
        done_sym, done_word = [], []
        top = np.iinfo(np.int32).max
        while len(sym):
            rank = np.full(len(sym), top, np.int32)
            made = np.zeros(len(sym), np.int32)
            r, m = self.pairs.find(sym[:-1], sym[1:])
            same = word[1:] == word[:-1]
            rank[:-1], made[:-1] = np.where(same, r, top), m
            start = np.flatnonzero(np.append(True, ~same))
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(sym))))
            live = best < top
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            sym, word, rank, made, best = sym[live], word[live], rank[live], made[live], best[live]
            hit = rank == best
            if hit.any():
                at = np.flatnonzero(hit)  # in a run like aaa every second one counts
                new_run = np.append(True, np.diff(at) > 1)
                run_start = at[np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))]
                at = at[(at - run_start) % 2 == 0]
                sym[at] = made[at]
                keep = np.ones(len(sym), bool)
                keep[at + 1] = False
                sym, word = sym[keep], word[keep]
        sym = np.concatenate([*done_sym, np.zeros(0, np.int32)])
        word = np.concatenate([*done_word, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(lens))

    def pretokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pretokens, their lengths, the id of an added token (else -1), pretokens of each text."""
        found: list[str] = []
        special: list[int] = []
        count = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            n = len(found)
            for part in self.split.split(t) if self.split else [t]:
                own = [part] if part in self.added else PATTERN.findall(part)
                found += own
                special += [self.added.get(part, -1)] * len(own)
            count[k] = len(found) - n
        joined = "".join(found).encode()
        lens = np.fromiter((len(w) for w in found), np.int64, len(found))
        data = np.frombuffer(joined, np.uint8)
        if len(data) != lens.sum():  # from code points to bytes
            starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            lens = np.diff(starts[np.append(0, np.cumsum(lens))])
        return data, lens, np.array(special, np.int64), count

    def encode_pretokens(self, data: np.ndarray, lens: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens, merged exactly."""
        at = offsets_of(lens)[:-1]
        ids_of, n_of = np.zeros(len(lens), np.int64), np.ones(len(lens), np.int64)
        added = np.array(special[special >= 0], np.int64)
        own = np.flatnonzero(special < 0)
        ids_of[special >= 0] = np.arange(len(added))
        self.merged += len(own)
        ids, n = self.merge(data[ragged(at[own], lens[own])], lens[own])
        ids_of[own], n_of[own] = len(added) + offsets_of(n)[:-1], n
        return np.concatenate([added, ids])[ragged(ids_of, n_of)], n_of

    def new(self, blk, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        together = joinable(blk, s, e)
        raw = blk.data.tobytes()
        joined = blk.data[ragged(s[together], (e - s)[together])].tobytes().decode()
        alone = np.flatnonzero(~together)
        data, lens, special, count = self.pretokens([joined, *(raw[s[i] : e[i]].decode() for i in alone)])
        ids, n = self.encode_pretokens(data, lens, special)
        # pretokens of the joined text back to its chunks, by bytes
        ends = np.append(0, np.cumsum(lens))
        first = np.searchsorted(ends[: count[0] + 1], np.append(0, np.cumsum((e - s)[together])))
        id_at = offsets_of(n)
        out_lens = np.zeros(len(s), np.int64)
        out_start = np.zeros(len(s), np.int64)
        out_start[together], out_lens[together] = id_at[first[:-1]], np.diff(id_at[first])
        own = id_at[np.cumsum(count)]
        out_start[alone], out_lens[alone] = own[:-1], np.diff(own)
        return ids[ragged(out_start, out_lens)].astype(self.memo.store.dtype), out_lens

    def encode(self, blk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of documents and their bounds by document.

        Chunks walk through the lexicon; those that it lacks are merged, each distinct one once.
        """
        if self.lexicon is None:
            return self.memo.encode(blk, self.added_bytes, self.new)
        s, e, first = chunks(blk, self.added_bytes)
        number = self.lexicon.find(blk.data, s, e - s)
        known = number >= 0
        rest = np.flatnonzero(~known)
        lex_ids, lex_lens = self.lexicon.outputs(number[known])
        ids, lens = self.memo.look_up(blk, s[rest], e[rest], self.new)
        self.in_lexicon += len(s) - len(rest)
        n, start = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        n[known], start[known] = lex_lens, offsets_of(lex_lens)[:-1]
        n[rest], start[rest] = lens, len(lex_ids) + offsets_of(lens)[:-1]
        both = np.concatenate([lex_ids.astype(ids.dtype), ids])
        return both[ragged(start, n)], offsets_of(segment_sum(n, first))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of documents given by ids, and their bounds."""
        ids = ids.astype(np.int64)
        n = self.word_len[ids]
        return self.word_bytes[ragged(self.word_at[ids], n)], np.append(0, np.cumsum(n))[bounds]
