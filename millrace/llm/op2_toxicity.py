"""Toxicity: class-conditional Kneser-Ney models with shared backoff counts.

Each class has a model of expressions (lower-case words between blanks and ASCII
punctuation), counted once in each text.  A word's probability is its discounted
count, and what the discounts free goes to the model of its first six bytes, whose
counts are continuation counts (distinct words with that beginning), and from there
to five, four and three bytes, then to the corpus.  How a word shares in its
beginning comes from counts over all documents, the same for both classes, so an
expression that a class never had is judged by what its relatives tell.  Discounts
are the modified Kneser-Ney ones, from the counts of counts, for both classes alike.

The decision compares log-likelihoods of the two classes, each divided by the number of
words it is of: over the whole text, over its best run of ``RUN`` words and over its best
word, so that neither a long text nor a short one has an advantage.  Logistic regression
on a part of the labelled rows that the counts left out weighs the three differences.

Class counts come from all labelled documents but those left to the regression: one in
``APART``, and of about ``MAX_TOXIC`` and ``MAX_ORDINARY`` texts at most.  The shared counts
are exact, over all documents.  A form that no class has had differs from its beginning by
a constant (its share is the same for both classes), so the table of ratios has the forms
of the labelled texts only.  Workers hold those of the ``FREQUENT`` most frequent forms and
a bit filter of the others.  A text with a word that passes the filter is reduced to what the
others could change of it: sums and maxima of what is known, and the runs that such words are in,
with the words' keys.  Those keys, and not the text, go through a join.

Defined results: null and empty texts and texts without words have no evidence and
get the score of a ratio of 0.  Without labels of both kinds every score is the share
of label 1 (0 if there are none).  A text that is labelled several times counts once for
each label.  Null ids are scored like others and never learned from; repeated rows are
scored alike; texts of any length are read whole; an empty table gives no rows.  Of the
input only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .op1_quality_classifier import held_out
from .store import drop, written
from .textcore import Block, arrow_map, blocks, mix, offsets_of, ragged, segment_reduce, segment_sum, table

MAX_TOXIC, MAX_ORDINARY = 3000, 6000
#: Forms at most whose ratios every worker holds.
FREQUENT = 1 << 20
#: Bits of the filter of the other forms, as a power of two.
FILTER_BITS = 24
#: Words that a task gathers before it sends their counts on.
GATHERED = 1 << 19
#: A table of ids up to so many rows is sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 1 << 20
STEMS = (6, 5, 4, 3)
KINDS = 1 + len(STEMS)
COUNTS = ["n", "a0", "a1"]  # occurrences in all documents; documents or forms of the ordinary and of the toxic class
COUNTED = "form binary, n bigint, a0 bigint, a1 bigint"
RUN = 4
#: One labelled document in so many is left to the logistic regression.
APART = 4

_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[48:58] = 48  # numbers count by their shape
_MAP[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0x20


def expressions(raw: Block) -> Block:
    """The block in lower case, digits as 0, ASCII punctuation blanked."""
    data = _MAP[raw.data]
    upper = np.zeros(len(data), bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[upper] += 0x20
    return raw.with_data(data)


def key_of(blk: Block, s: np.ndarray, e: np.ndarray, kind: int) -> np.ndarray:
    """64-bit keys of words (kind 0) or of their beginnings."""
    return blk.hash_spans(s, np.minimum(e, s + STEMS[kind - 1]) if kind else e, 2 + kind)


def spans(blk: Block, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The bytes of spans as an Arrow column."""
    off = offsets_of(e - s).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(blk.data[ragged(s, e - s)].tobytes())])


def folded(parts: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sums the counts (COUNTS x words) of equal words, over as many parts as memory allows."""
    held, size = [], 0

    def fold() -> pa.Table:
        t = pa.concat_tables(held).group_by("form").aggregate([(c, "sum") for c in COUNTS])
        return t.select(["form", *(f"{c}_sum" for c in COUNTS)]).rename_columns(["form", *COUNTS])

    for words, n in parts:
        if not len(words):
            continue
        held.append(pa.table([words, *(pa.array(x.astype(np.int64)) for x in n)], names=["form", *COUNTS]))
        size += len(words)
        if size > GATHERED:
            held = [fold()]
            size = held[0].num_rows
            if size > GATHERED // 2:
                yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                held, size = [], 0
    if held:
        yield from fold().combine_chunks().to_batches(max_chunksize=1 << 16)


def vocabulary(docs: DataFrame) -> DataFrame:
    """All words of the documents and their occurrences; a word may have several rows."""

    def count(batches):
        def parts():
            for _, raw in blocks(batches):
                blk = expressions(raw)
                s, e, _ = blk.words()
                _, one, n = np.unique(blk.hash_spans(s, e), return_index=True, return_counts=True)
                yield spans(blk, s[one], e[one]), np.stack([n, 0 * n, 0 * n])

        yield from folded(parts())

    return arrow_map(docs.select("text"), count, COUNTED)


def class_counts(rows: DataFrame) -> DataFrame:
    """The words of labelled texts and the texts of each class that have them."""

    def count(batches):
        def parts():
            for b, raw in blocks(batches):
                blk = expressions(raw)
                s, e, first = blk.words()
                doc = np.repeat(np.arange(blk.n), np.diff(first))
                _, once = np.unique(mix(blk.hash_spans(s, e) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                toxic = b.column("toxic").to_numpy()[doc[once]]
                yield spans(blk, s[once], e[once]), np.stack([0 * once, toxic == 0, toxic == 1])

        yield from folded(parts())

    return arrow_map(rows.select("text", "toxic"), count, COUNTED)


def discounts(counts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more."""
    n = [max(int(times[counts == k].sum()), 1) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0, 0.05, 0.1, 0.15], [0, 0.98, 1.9, 2.8])


@dataclass
class Level:
    """Discounts of one level for one class, from its counts.

    With ``times`` a count stands for so many keys.
    """

    key: np.ndarray
    count: np.ndarray
    times: np.ndarray | None = None

    def __post_init__(self):
        times = np.ones(len(self.count), np.int64) if self.times is None else self.times
        self.d = discounts(self.count, times)
        d = self.d[np.minimum(self.count, 3).astype(int)]
        self.total = max(float((self.count * times).sum()), 1.0)
        self.left = np.maximum(self.count - d, 0) / self.total
        self.freed = max(float((d * times).sum()) / self.total, 1e-6) if len(self.count) else 1.0

    def prob(self, count: Column) -> Column:
        """What is left of a count, as a probability."""
        d = [float(x) for x in self.d]
        less = F.when(count >= 3, d[3]).when(count == 2, d[2]).when(count == 1, d[1]).otherwise(0.0)
        return F.greatest(count - less, F.lit(0.0)) / self.total


def levels_of(words: DataFrame) -> list[DataFrame]:
    """Written tables of words and of each length of beginning: form and COUNTS.

    For beginnings the classes have continuation counts: distinct forms one level up.
    """
    out = [written(words.groupBy("form").agg(*(F.sum(c).alias(c) for c in COUNTS)), "words")]
    for k, size in enumerate(STEMS):
        up = out[-1].groupBy(F.substring("form", 1, size).alias("form")).agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(c) for c in COUNTS[1:]))
        out.append(written(up, f"beginnings{STEMS[k]}"))
    return out


@dataclass
class Model:
    classes: list[list[Level]]  #: ordinary, toxic; words first, then the beginnings
    known: DataFrame | None = None  #: key, n and ratio of all forms that a class has had
    weights: np.ndarray | None = None  #: intercept and a weight for each feature
    share: float = 0.0

    @property
    def steps(self) -> np.ndarray:
        """What a form that no class has had differs by from its beginning, for each kind."""
        return np.array([np.log(b.freed) - np.log(a.freed) for a, b in zip(*self.classes, strict=True)])

    def ratios(self, tables: list[DataFrame], base: float) -> DataFrame:
        """key, n, ratio: log-likelihood ratios, toxic to ordinary, of all forms that a class has had."""
        below, out = None, []
        for k in reversed(range(KINDS)):
            t, s = tables[k].where("a0 > 0 or a1 > 0"), F.col("n") + 1
            if below is None:  # the corpus's share of the shortest beginning
                shares = [s / base] * 2
            else:  # the longer form's share in the shorter one, from the shared counts
                t = t.withColumn("up", F.substring("form", 1, STEMS[k])).join(below, "up")
                shares = [F.col(f"p{c}") * s / F.col("s") for c in (0, 1)]
            p = [level[k].prob(F.col(f"a{c}")) + level[k].freed * shares[c] for c, level in enumerate(self.classes)]
            own = written(t.select("form", "n", s.alias("s"), *(x.alias(f"q{c}") for c, x in enumerate(p))), f"chances{k}")
            below = own.select(F.col("form").alias("up"), "s", F.col("q0").alias("p0"), F.col("q1").alias("p1"))
            out.append(own.select("form", "n", (F.log("q1") - F.log("q0")).alias("ratio"), F.lit(k).alias("kind")))

        def keyed(batches):
            for b in batches:
                if b.num_rows:
                    form, kind = b.column("form").cast(pa.binary()), b.column("kind").to_numpy()
                    off = np.frombuffer(form.buffers()[1], np.int32, len(form) + 1, form.offset * 4).astype(np.int64)
                    data = np.frombuffer(form.buffers()[2] or b"", np.uint8)
                    blk = Block(data, np.array([0, len(data)]))
                    key = np.zeros(len(form), np.uint64)
                    for k in np.unique(kind):
                        at = np.flatnonzero(kind == k)
                        key[at] = blk.hash_spans(off[at], off[at + 1], 2 + int(k))
                    yield pa.record_batch([pa.array(key.view(np.int64)), b.column("n"), b.column("ratio")], names=["key", "n", "ratio"])

        every = out[0]
        for x in out[1:]:
            every = every.unionAll(x)
        return written(arrow_map(every, keyed, "key bigint, n bigint, ratio double"), "ratios")

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -40, 40)))


def features(blk: Block, r: np.ndarray) -> np.ndarray:
    """Means over a text, its best run and its best word, from the ratios of all words."""
    first = blk.words()[2]
    n = np.diff(first)
    mean = segment_sum(r, first) / np.maximum(n, 1)
    best = segment_reduce(np.maximum, r, first, 0.0)
    c = np.append(0, np.cumsum(r))
    doc_end = np.repeat(first[1:], n)
    to = np.minimum(np.arange(len(r)) + RUN, doc_end)
    run = segment_reduce(np.maximum, (c[to] - c[:-1]) / RUN, first, 0.0)
    return np.column_stack([mean, run, best])


@dataclass
class Words:
    """Ratios by sorted key."""

    key: np.ndarray
    ratio: np.ndarray

    @staticmethod
    def of(key: np.ndarray, ratio: np.ndarray) -> Words:
        key, one = np.unique(key.astype(np.int64, copy=False).view(np.uint64), return_index=True)
        return Words(key, ratio[one])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios, and which of the words are there."""
        if not len(self.key):
            return np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return self.ratio[at], self.key[at] == h


@dataclass
class Held:
    """What every worker has: ratios of frequent forms, the filter of the others, steps to beginnings."""

    words: Words
    others: np.ndarray | None  #: packed bits; None if there are no others
    steps: np.ndarray

    def perhaps(self, key: np.ndarray) -> np.ndarray:
        """Which keys may be those of other forms."""
        at = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (self.others[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Lookup:
    """Ratios of words, with a memo of fixed size of those that a worker has met."""

    def __init__(self, held: Held, bits: int = 18):
        self.held, self.shift = held, np.uint64(64 - bits)
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)

    def ratios(self, blk: Block) -> np.ndarray:
        """A ratio for each word of a block; NaN where a form may be among the others."""
        s, e, _ = blk.words()
        h = blk.hash_spans(s, e)
        at = (h >> self.shift).astype(np.int64)
        out = self.value[at]
        miss = np.flatnonzero(self.key[at] != h)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            new, asked, _, _ = self.resolved(blk, s[one], e[one])
            new[asked] = np.nan
            self.key[at[one]], self.value[at[one]] = h[one], new
            out[miss] = new[back]
        return out

    def resolved(self, blk: Block, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ratios of words by their longest form known here; words, keys and kinds that the others must be asked for, the longest first."""
        out, total = np.zeros(len(s)), 0.0
        live, asked, keys, kinds = np.arange(len(s)), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k in range(KINDS):
            key = key_of(blk, s[live], e[live], k)
            r, has = self.held.words.find(key)
            if self.held.others is not None:
                ask = ~has & self.held.perhaps(key)
                asked.append(live[ask])
                keys.append(key[ask])
                kinds.append(np.full(ask.sum(), k))
            out[live[has]] = total + r[has]
            live = live[~has]
            total += self.held.steps[k]
        out[live] = total
        return out, np.concatenate(asked), np.concatenate(keys), np.concatenate(kinds)


EVIDENCE = "row bigint, id {kind}, x0 double, x1 double, x2 double, n bigint, times array<int>, ratio array<float>, form array<int>, key array<bigint>, near array<float>, near_word array<int>"


def _lists(values: np.ndarray, of: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values, sorted by ``of``, as one list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def evidence(look: Lookup, ids: pa.Array, blk: Block, row: int) -> pa.RecordBatch:
    """Features of texts whose words are all known here (n is null), and of the others what follows.

    x0: sum of the known ratios; x1, x2: best run and best word among those that are known
    whole.  n: words.  times, ratio: occurrences of each open word, and its ratio if the others have
    none of its forms.  form, key: forms to ask for, word * 8 + kind.  near, near_word: the words from
    which a run may reach an open one or that it may reach, one stretch after the other, as their
    ratio or the number of the open word (-1: known; -2: the stretch before has ended).
    """
    s, e, first = blk.words()
    n = np.diff(first)
    r = look.ratios(blk)
    doc = np.repeat(np.arange(blk.n), n)
    is_open = np.isnan(r)
    open_ = np.flatnonzero(is_open)
    known = np.nan_to_num(r)
    x = features(blk, known)
    waits = np.zeros(blk.n, bool)
    waits[doc[open_]] = True
    # distinct open words of each text
    h = blk.hash_spans(s[open_], e[open_])
    order = np.lexsort((h, doc[open_]))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[open_][order][1:] != doc[open_][order][:-1])
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1  # of each open place its word
    one = open_[order[new]]
    word_doc = doc[one]
    place = np.arange(len(one)) - np.searchsorted(word_doc, word_doc)  # of each word, within its text
    ratio, asked, keys, kinds = look.resolved(blk, s[one], e[one])
    by_word = np.lexsort((kinds, asked))
    asked, keys, kinds = asked[by_word], keys[by_word], kinds[by_word]
    # runs
    to = np.minimum(np.arange(len(r)) + RUN, np.repeat(first[1:], n))
    c, c_open = np.append(0, np.cumsum(known)), np.append(0, np.cumsum(is_open))
    sums, has_open = c[to] - c[:-1], c_open[to] > c_open[:-1]
    runs = np.flatnonzero(has_open)
    at = np.full(len(r) + RUN, -1, np.int64)
    at[open_] = place[own]
    near = np.zeros(len(r) + RUN, bool)  # the words of runs that have an open one
    for j in range(RUN):
        near[np.minimum(runs + j, to[runs] - 1)] = True
    near = np.flatnonzero(near)
    apart = np.append(True, (np.diff(near) > 1) | (np.diff(doc[near]) > 0)) if len(near) else np.zeros(0, bool)
    # a mark before each stretch but the first of a text; the text's end is one by itself
    inner = np.flatnonzero(apart & np.append(False, np.diff(doc[near]) == 0)) if len(near) else apart
    near_doc = np.insert(doc[near], inner, doc[near[inner]]) if len(near) else doc[near]
    near_word, near_ratio = np.insert(at[near], inner, -2), np.insert(known[near], inner, 0.0)
    best_run = segment_reduce(np.maximum, np.where(has_open, -np.inf, sums / RUN), first, 0.0)
    best_word = segment_reduce(np.maximum, np.where(is_open, -np.inf, r), first, 0.0)
    x = np.where(waits[:, None], np.column_stack([segment_sum(known, first), best_run, best_word]), x)
    cols = [
        pa.array(row + np.arange(blk.n)), ids, *(pa.array(x[:, k]) for k in range(3)), pa.array(n, mask=~waits),
        _lists(np.bincount(own, minlength=len(one)), word_doc, blk.n, pa.int32()), _lists(ratio.astype(np.float32), word_doc, blk.n, pa.float32()),
        _lists(place[asked] * 8 + kinds, word_doc[asked], blk.n, pa.int32()), _lists(keys.view(np.int64), word_doc[asked], blk.n, pa.int64()),
        _lists(near_ratio.astype(np.float32), near_doc, blk.n, pa.float32()), _lists(near_word, near_doc, blk.n, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["row", "id", "x0", "x1", "x2", "n", "times", "ratio", "form", "key", "near", "near_word"])


def _flat(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column and the bounds of each row; null lists are empty."""
    values = col.flatten()
    return values, offsets_of(np.nan_to_num(pc.list_value_length(col).to_numpy(zero_copy_only=False)).astype(np.int64))


def concluded(b: pa.RecordBatch, steps: np.ndarray) -> np.ndarray:
    """Features of texts with open words, from their evidence and what the others told of them."""
    ratio, words = _flat(b.column("ratio"))
    times, _ = _flat(b.column("times"))
    told, bounds = _flat(b.column("told"))
    w = ratio.to_numpy().astype(float)
    form = told.field("form").to_numpy()
    word, kind = words[np.repeat(np.arange(b.num_rows), np.diff(bounds))] + (form >> 3), form & 7
    value = told.field("ratio").to_numpy() + np.append(0, np.cumsum(steps))[kind]
    order = np.lexsort((-kind, word))  # the longest form comes last and counts
    w[word[order]] = value[order]
    near, places = _flat(b.column("near"))
    of, _ = _flat(b.column("near_word"))
    near, of = near.to_numpy().astype(float), of.to_numpy()
    base = words[np.repeat(np.arange(b.num_rows), np.diff(places))]
    near[of >= 0] = w[(base + of)[of >= 0]]
    # runs end with their stretch; one that the stretch cuts short has no open word and doesn't count
    end = np.zeros(len(of) + 1, bool)
    end[:-1] = of == -2
    end[places] = True
    stop = np.flatnonzero(end)
    to = np.minimum(np.arange(len(of)) + RUN, stop[np.searchsorted(stop, np.arange(len(of)), "right")]) if len(of) else np.zeros(0, np.int64)
    c, c_open = np.append(0, np.cumsum(near)), np.append(0, np.cumsum(of >= 0))
    run = np.where((c_open[to] > c_open[:-1]) & (of != -2), (c[to] - c[:-1]) / RUN, -np.inf)
    x0, x1, x2 = (b.column(f"x{k}").to_numpy() for k in range(3))
    total = x0 + segment_sum(w * times.to_numpy(), words)
    return np.column_stack([total / b.column("n").to_numpy(), np.maximum(x1, segment_reduce(np.maximum, run, places, -np.inf)), np.maximum(x2, segment_reduce(np.maximum, w, words, -np.inf))])


def held_of(model: Model) -> tuple[Held, DataFrame | None]:
    """The most frequent forms, by a level of their counts, and a table of the others if there are any."""
    known = model.known
    level = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double"))).cast("int")
    rows = {r["level"]: r["c"] for r in known.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()}  # 64 at most
    least, total = 64, 0
    for k in sorted(rows, reverse=True):
        if total + rows[k] > FREQUENT:
            break
        least, total = k, total + rows[k]
    got = known.where(level >= least).select("key", "ratio").toArrow()  # FREQUENT at most
    words = Words.of(got["key"].to_numpy(), got["ratio"].to_numpy())
    if total == sum(rows.values()):
        return Held(words, None, model.steps), None
    others = known.where(level < least).select("key", "ratio")
    slot = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    bits = others.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63))")).alias("bits")).toArrow()  # 2**(FILTER_BITS - 6) at most
    packed = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    packed[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return Held(words, packed, model.steps), others


def measured(docs: DataFrame, model: Model, finish, kind: str, schema: str) -> DataFrame:
    """finish(ids, features) of all documents (id of type ``kind``, text); it gives rows of ``schema``."""
    held, others = held_of(model)
    held = docs.sparkSession.sparkContext.broadcast(held)
    if others is None:

        def whole(batches):
            look = Lookup(held.value)
            for b, raw in blocks(batches):
                blk = expressions(raw)
                yield finish(b.column("id"), features(blk, look.ratios(blk)))

        return arrow_map(docs, whole, schema)

    def first(batches):
        look, row = Lookup(held.value), TaskContext.get().partitionId() << 40
        for b, raw in blocks(batches):
            yield evidence(look, b.column("id"), expressions(raw), row)
            row += b.num_rows

    def second(batches):
        for b in batches:
            if b.num_rows:
                yield finish(b.column("id"), concluded(b, held.value.steps))

    def done(batches):
        for b in batches:
            if b.num_rows:
                yield finish(b.column("id"), np.column_stack([b.column(f"x{k}").to_numpy() for k in range(3)]))

    read = written(arrow_map(docs, first, EVIDENCE.format(kind=kind)), "evidence")
    wait = read.where(F.col("n").isNotNull())
    asked = wait.select("row", F.explode(F.arrays_zip("form", "key")).alias("a")).select("row", "a.*")
    told = asked.join(others, "key").groupBy("row").agg(F.collect_list(F.struct("form", "ratio")).alias("told"))  # of one text
    rest = wait.drop("form", "key").join(told, "row", "left")
    return arrow_map(read.where(F.col("n").isNull()).select("id", "x0", "x1", "x2"), done, schema).unionAll(arrow_map(rest, second, schema))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Newton's method on standardised features."""
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-9)
    b = np.column_stack([np.ones(len(x)), (x - mean) / std])
    w = np.zeros(b.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(b @ w, -30, 30)))
        h = (b * (p * (1 - p))[:, None]).T @ b / len(x) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, b.T @ (p - y) / len(x) + ridge * w)
    slopes = w[1:] / std
    return np.append(w[0] - slopes @ mean, slopes)


def labelled(docs: DataFrame, labels: DataFrame, allowed=None) -> DataFrame:
    """text, toxic, apart of all labelled rows, each text once for a label; about MAX_TOXIC and MAX_ORDINARY / APART are apart."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.where(allowed(F.col("doc_id"))) if allowed is not None else rows
    rows = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    once = hashed.join(rows, "doc_id").groupBy("h", "toxic", "doc_id").agg(F.count("*").alias("times"))
    own = written(once.groupBy("h", "toxic").agg(F.min(F.struct("doc_id", "times")).alias("d")).select("h", "toxic", "d.*"), "labelled")  # ids only
    n = {r["toxic"]: (r["n"], r["most"]) for r in own.groupBy("toxic").agg(F.count("*").alias("n"), F.max("times").alias("most")).collect()}
    below = lambda t, most: int((1 << 40) / APART * min(1.0, most / max(n.get(t, (0, 0))[0], 1)))
    apart = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 40)) < F.when(F.col("toxic") == 1, below(1, MAX_TOXIC)).otherwise(below(0, MAX_ORDINARY))
    small = sum(c for c, _ in n.values()) <= BROADCAST_ROWS
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(F.broadcast(own) if small else own, ["doc_id", "h"])
    if any(most > 1 for _, most in n.values()):  # rows that are repeated, id and all
        texts = texts.where("times = 1").unionAll(texts.where("times > 1").dropDuplicates(["doc_id", "h", "toxic"]))
    return texts.select("text", "toxic", apart.alias("apart"))


def learn(docs: DataFrame, labels: DataFrame, allowed=None) -> Model:
    rows = labelled(docs, labels, allowed)
    tables = levels_of(vocabulary(docs).unionAll(class_counts(rows.where("not apart"))))
    sums = None
    for k, t in enumerate(tables):  # counts of counts: 5 rows a level and class
        a = t.select(F.lit(k).alias("kind"), F.expr("stack(2, 0, a0, 1, a1) as (toxic, a)")).where("a > 0")
        a = a.groupBy("kind", "toxic", F.least("a", F.lit(5)).alias("count")).agg(F.count("*").alias("times"), F.sum("a").alias("total"))
        sums = a if sums is None else sums.unionAll(a)
    sums = sums.toPandas()
    classes = [[], []]
    for t in (0, 1):
        for k in range(KINDS):
            own = sums[(sums["toxic"] == t) & (sums["kind"] == k)].sort_values("count")
            n = own["times"].to_numpy(np.int64)
            classes[t].append(Level(own["count"].to_numpy(), own["total"].to_numpy(float) / n, n))
    short = tables[-1].agg(F.sum(F.col("n") + 1).alias("n")).first()["n"] or 0
    model = Model(classes)
    model.known = model.ratios(tables, float(short + 1))
    for t in tables:
        drop(t)

    def weigh(toxic, x):
        return pa.record_batch([toxic, *(pa.array(x[:, k]) for k in range(3))], names=["toxic", "x0", "x1", "x2"])

    x = measured(rows.where("apart").select(F.col("toxic").alias("id"), "text"), model, weigh, "int", "toxic int, x0 double, x1 double, x2 double").toPandas().sort_values(["toxic", "x0", "x1", "x2"])
    y = x["toxic"].to_numpy(float)
    model.share = float(y.mean()) if len(y) else 0.0
    if len(y) and 0 < y.mean() < 1:
        model.weights = logistic(x[["x0", "x1", "x2"]].to_numpy(), y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, score, predicted, and the mean log-likelihood ratio of each text."""
    weights = Model([], None, model.weights, model.share)  # without what only the driver has
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(ids, x):
        s = weights.score(x)
        return pa.RecordBatch.from_arrays([ids, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x[:, 0])], names=["id", "score", "predicted", "mean_ratio"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return measured(rows, model, finish, kind, f"id {kind}, score double, predicted int, mean_ratio double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), allowed=lambda c: ~held_out(c, 5, 0))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "mean_ratio")
