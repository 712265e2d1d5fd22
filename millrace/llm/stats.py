"""Statistics of texts on which the quality operators decide.

All are computed for whole texts, a block of documents at a time.  A null or
empty text has the value 0 in every column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textcore import IS_SPACE, Block, mix, run_hashes, segment_sum

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8

COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_bangs", "n_punct", "n_same_next"]
#: Shares, which don't depend on a text's length.
RATIOS = ["symbol_share", "upper_share", "bang_share", "digit_share", "punct_share", "dup_line_share", "repeat_share", "same_next_share", "mean_word"]


def _flags(*which: np.ndarray) -> np.ndarray:
    """Byte table that adds two counters at once, 32 bits each."""
    out = np.zeros(256, np.uint64)
    for k, w in enumerate(which):
        out[w] += np.uint64(1 << (32 * k))
    return out


_b = np.arange(256)
_is = lambda s: np.isin(_b, list(s))
_START = (_b & 0xC0) != 0x80
_UPPER, _LOWER, _DIGIT = (_b >= 65) & (_b <= 90), (_b >= 97) & (_b <= 122), (_b >= 48) & (_b <= 57)
_PUNCT = (_b > 32) & (_b < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_PAIRS = [
    (("n_chars", "word_chars"), _flags(_START, _START & ~IS_SPACE)),
    (("n_symbols", "n_upper"), _flags(_is(SYMBOLS), _UPPER)),
    (("n_letters", "n_digits"), _flags(_UPPER | _LOWER | (_b >= 0xC0), _DIGIT)),
    (("n_bangs", "n_punct"), _flags(_is(b"!"), _PUNCT)),
]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def block_counts(blk: Block) -> dict[str, np.ndarray]:
    """COUNTS for each document of a block, as int64."""
    bounds, n = blk.bounds, blk.n
    out: dict[str, np.ndarray] = {}
    for names, codes in _PAIRS:
        both = np.add.reduceat(codes[blk.data], bounds[:-1])
        out[names[0]] = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[names[1]] = (both >> np.uint64(32)).astype(np.int64)
    out["n_chars"] -= 1  # the blank after each document
    s, _, first = blk.words()
    wh = blk.word_hashes()
    out["n_words"] = np.diff(first)

    # words in windows that the text has twice or more
    win, wb = run_hashes(wh, first, REPEAT_WINDOW, short=False)
    doc = np.repeat(np.arange(n), np.diff(wb))
    twice = _repeated(mix(win + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at = np.flatnonzero(twice)
    at = at - wb[doc[at]] + first[doc[at]]  # index of the window's first word
    edge = np.zeros(len(wh) + REPEAT_WINDOW + 1, np.int64)
    edge[at] += 1
    edge[at + REPEAT_WINDOW] -= 1
    out["n_repeat_words"] = segment_sum((np.cumsum(edge)[: len(wh)] > 0).astype(np.int64), first)

    same = np.zeros(len(wh), np.int64)
    same[1:] = wh[1:] == wh[:-1]
    same[first[:-1][first[:-1] < len(wh)]] = 0
    out["n_same_next"] = segment_sum(same, first)

    # lines with a word that equal an earlier line
    nl = np.flatnonzero(blk.data == 10)
    ls = np.sort(np.concatenate([blk.doc_start, nl + 1]))
    le = np.sort(np.concatenate([nl, blk.doc_end]))
    filled = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le = ls[filled], le[filled]
    ldoc = np.searchsorted(blk.doc_start, ls, "right") - 1
    out["n_lines"] = np.bincount(ldoc, minlength=n)
    key = mix(blk.hash_spans(ls, le) + ldoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    later = order[1:][key[order[1:]] == key[order[:-1]]]
    out["n_dup_lines"] = np.bincount(ldoc[later], minlength=n)
    return out


def ratios(c: dict[str, np.ndarray]) -> np.ndarray:
    """RATIOS as a float matrix, a row for each document."""
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    letters = np.maximum(c["n_letters"], 1).astype(float)
    return np.column_stack([c["n_symbols"] / chars, c["n_upper"] / letters, c["n_bangs"] / chars, c["n_digits"] / chars, c["n_punct"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_same_next"] / words, c["word_chars"] / words])


def arrow_counts(c: dict[str, np.ndarray], names: list[str]) -> list[pa.Array]:
    return [pa.array(c[k].astype(np.int64)) for k in names]
