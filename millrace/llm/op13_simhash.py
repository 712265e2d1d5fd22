"""SimHash near-duplicates: fingerprints compared bit-sliced, in groups that no link is lost by.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes (seed 42) of
all runs of ``SHINGLE`` words, repeats included.  Two fingerprints are linked if at most
``RADIUS`` bits differ.

Candidates: the bits are cut into more parts than may differ, so two linked fingerprints agree
in all parts but ``RADIUS`` at least.  Every choice of so many parts, with the bits there, is a
bucket, and a linked pair meets in one.  The number of parts follows from how many different
fingerprints there are, so that a bucket of evenly spread ones stays near ``FULL``.  A bucket with
more than ``BLOCK`` is dealt out to blocks, and every pair of its blocks is a unit of its own.

Comparison, in Arrow workers: the rows of many units stand side by side, one bit plane for each
bit of the fingerprints, 64 rows in a word.  All rows are compared with those 1, 2, 3, ... places
further on: a plane is XORed with itself shifted by that many bits, and the differences of all
planes are counted by carry-save adders, 64 pairs in one instruction.  Words in which every pair
has left the radius (or isn't of one unit) are abandoned, and only the rest is counted to the end.
Linked pairs are joined to trees at once, so a unit gives a row less than it has members, however
dense its links are.  Trees of all units are then joined to components.

Defined results: null texts and texts without words have fingerprint zero, which is linked like
any other.  Rows of equal fingerprint are one node, whatever their number.  ``component_id`` is
the least id reachable; null ids are passed over, and it is null if there is no other.  Repeated
rows come out once each.  Bytes that are no UTF-8 are hashed as they are.  Texts of any length are
read whole.  Other columns, of any names, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .sketch import linked_roots
from .store import drop, written
from .textcore import IS_SPACE, arrow_map, blocks, table

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Fingerprints of an evenly spread bucket, about; those of a block of an uneven one.
FULL, BLOCK = 1024, 4096
#: Rows that are compared at once, if units are small.
ROWS = 1 << 14
#: Hashes whose bits are counted at once.
_PIECE = 1 << 16
_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each slice h[bounds[i]:bounds[i+1]] the bits that over half of it have."""
    n = np.diff(bounds)
    ones = np.zeros((len(n), BITS), np.int64)
    for a in range(0, len(h), _PIECE):
        bits = np.unpackbits(h[a : a + _PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(bounds, [a, a + len(bits) - 1], "right") - 1
        at = np.clip(bounds[first : last + 2] - a, 0, len(bits))
        live = at[1:] > at[:-1]
        ones[first : last + 1][live] += np.add.reduceat(bits, at[:-1][live], axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprints(batches):
    for b, blk in blocks(batches):
        s, e, first = blk.words()
        size = e - s
        # all words of a block with one blank after each: runs of words are slices of that
        at = np.append(0, np.cumsum(size + 1))
        spaced = np.full(at[-1], 0x20, np.uint8)
        inner = np.ones(at[-1], bool)
        inner[at[1:] - 1] = False
        spaced[inner] = _LOWER[blk.data[~IS_SPACE[blk.data]]]
        n = np.diff(first)
        runs = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        bounds = np.append(0, np.cumsum(runs))
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], runs)
        length = np.repeat(np.minimum(n, SHINGLE), runs)
        begin, end = at[place].tolist(), (at[place + length] - 1).tolist()
        raw = spaced.tobytes()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(raw[x:y], SEED) for x, y in zip(begin, end, strict=True)), np.uint64, len(begin))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(majority(h, bounds).view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp of every row; fp as a signed whole number of the same 64 bits."""
    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), _fingerprints, f"id {kind}, fp bigint")


def masks(count: int, radius: int = RADIUS, full: int = FULL) -> list[int]:
    """The bits that make the buckets: for each choice of parts that agree a mask, from as few parts as keep evenly spread buckets near ``full``."""
    if not 0 <= radius <= 6:
        raise ValueError("the counters hold radii of 0 to 6")
    for parts in range(radius + 1, radius + 7):
        cuts = [k * BITS // parts for k in range(parts + 1)]
        own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out = [sum(own[k] for k in chosen) for chosen in combinations(range(parts), parts - radius)]
        if count >> min(m.bit_count() for m in out) <= full:
            break
    return out


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def bucket_rows(nodes: DataFrame, chosen: list[int]) -> DataFrame:
    """choice, bits, fp: each node in each of its buckets."""
    of = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in chosen]))
    return nodes.select("fp", of.alias("choice", "bits")).select("choice", "bits", "fp")


def in_units(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """choice, bits, i, j, side, fp: buckets of more than ``block`` are dealt out to pairs of blocks, i at most j."""
    most = written(rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > block), "full_buckets")
    if most.isEmpty():
        return rows.select("choice", "bits", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp")
    rows = rows.join(most, ["choice", "bits"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("choice", "bits", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "fp")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sums and carries of three bits."""
    u = a ^ b
    return u ^ c, a & b | u & c


class _Counter:
    """Counts up to 7 differing bits of 64 pairs a word, in three bit planes; what goes beyond stays marked."""

    def __init__(self, beyond: np.ndarray):
        self.ones, self.twos, self.fours, self.beyond = np.zeros_like(beyond), np.zeros_like(beyond), np.zeros_like(beyond), beyond

    def four(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        """Counts four planes of differences."""
        self.ones, x = _add(self.ones, a, b)
        self.ones, y = _add(self.ones, c, d)
        self.twos, z = _add(self.twos, x, y)
        self.beyond |= self.fours & z
        self.fours ^= z

    def left(self, radius: int) -> np.ndarray:
        """Marks pairs of more than ``radius`` differences (at most 6)."""
        more, same = np.zeros_like(self.ones), np.full_like(self.ones, _ALL)
        for k, plane in ((2, self.fours), (1, self.twos), (0, self.ones)):
            if radius >> k & 1:
                same &= plane
            else:
                more |= same & plane
                same &= ~plane
        return more | self.beyond

    def take(self, at: np.ndarray) -> None:
        self.ones, self.twos, self.fours, self.beyond = self.ones[at], self.twos[at], self.fours[at], self.beyond[at]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Booleans as words of 64, the first in the lowest bit; two empty words follow."""
    words = -(-len(bits) // 64) + 2
    out = np.zeros(words * 8, np.uint8)
    b = np.packbits(bits, bitorder="little")
    out[: len(b)] = b
    return out.view("<u8")


def _shifted(plane: np.ndarray) -> np.ndarray:
    """The plane moved down by 0 to 63 bits, as 64 rows."""
    r = np.arange(64, dtype=np.uint64)[:, None]
    up = np.append(plane[1:], _U(0))
    return plane[None] >> r | (up[None] << _U(1)) << (_U(63) - r)


#: Planes that are counted for all words before words are abandoned.
_DENSE = 24


def linked(fp: np.ndarray, unit: np.ndarray, side: np.ndarray, cross: np.ndarray, same: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i, j), i < j, of one unit at a distance of at most ``radius``.

    Rows stand in order of their unit.  ``cross`` tells of which units only pairs of two sides are
    wanted; ``same`` has the bits that all rows of a unit share.
    """
    n = len(fp)
    planes = [_packed(fp >> _U(b) & _U(1) != 0) for b in range(BITS) if not same >> b & 1]
    planes += [np.zeros_like(planes[0])] * (-len(planes) % 4)
    words = len(planes[0]) - 2
    dense = min(_DENSE, len(planes))
    moved = [_shifted(p) for p in planes[:dense]]
    starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    ends = np.append(starts[1:], n)
    until = np.repeat(ends, ends - starts)  # of each row, where its unit ends
    two_sided = cross.any()
    for k in range(int((ends - starts).max() - 1) // 64 + 1):
        # pairs of row x and row x + d, d = 64 k + r, in row r and bit x
        d = 64 * k + np.arange(64)
        rows = np.flatnonzero(until - np.arange(n) > 64 * k)
        near = np.zeros((64, words * 64), bool)
        for r in range(64):
            if d[r]:
                x = rows[until[rows] - rows > d[r]]
                if two_sided:
                    x = x[~cross[x] | (side[x] != side[x + d[r]])]
                near[r, x] = True
        apart = ~np.packbits(near, axis=1, bitorder="little").view("<u8")
        at = np.flatnonzero((apart != _ALL).any(0))  # columns of words that hold a pair
        if not len(at):
            continue
        counter = _Counter(apart[:, at])
        ahead = np.minimum(at + k, words + 1)
        for b in range(0, dense, 4):
            counter.four(*(planes[c][at][None] ^ moved[c][:, ahead] for c in range(b, b + 4)))
        gone = counter.left(radius)
        r, w = np.nonzero(gone != _ALL)
        if not len(r):
            continue
        counter.beyond = gone
        for name in ("ones", "twos", "fours", "beyond"):
            setattr(counter, name, getattr(counter, name)[r, w])
        w = at[w]
        for b in range(dense, len(planes), 4):
            low, high = np.minimum(w + k, words + 1), np.minimum(w + k + 1, words + 1)
            shift = r.astype(np.uint64)
            counter.four(*(planes[c][w] ^ (planes[c][low] >> shift | (planes[c][high] << _U(1)) << (_U(63) - shift)) for c in range(b, b + 4)))
            gone = counter.left(radius)
            live = np.flatnonzero(gone != _ALL)
            counter.take(live)
            r, w = r[live], w[live]
        hit = np.unpackbits((~counter.left(radius)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(hit)
        i = w[at] * 64 + bit
        if len(i):
            yield i, i + d[r[at]]


def _joined(roots: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots after the links u-v, in which only what isn't joined yet counts."""
    a, b = roots[u], roots[v]
    new = a != b
    if not new.any():
        return roots
    ends, back = np.unique(np.concatenate([a[new], b[new]]), return_inverse=True)
    own = linked_roots(len(ends), back[: new.sum()], back[new.sum() :])
    to = np.arange(len(roots))
    to[ends] = ends[own]
    return to[roots]


def _units(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[list[np.ndarray]]:
    """Columns choice, bits, i, j, side, fp of whole units of one choice, about ``rows`` together."""
    held: list[np.ndarray] | None = None
    for b in batches:
        new = [b.column(k).to_numpy() for k in range(6)]
        held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
        while len(held[0]) > rows:
            change = np.flatnonzero(np.any([held[k][1:] != held[k][:-1] for k in range(4)], axis=0)) + 1
            other = np.flatnonzero(held[0] != held[0][0])
            cuts = change[change <= (other[0] if len(other) else len(held[0]))]
            if not len(cuts):
                break  # one unit, which hasn't ended
            fit = cuts[cuts <= rows]
            to = int(fit[-1] if len(fit) else cuts[0])
            yield [x[:to] for x in held]
            held = [x[to:] for x in held]
    while held is not None and len(held[0]):
        other = np.flatnonzero(held[0] != held[0][0])
        to = int(other[0]) if len(other) else len(held[0])
        yield [x[:to] for x in held]
        held = [x[to:] for x in held]


def _trees(chosen: list[int], radius: int):
    def run(batches):
        for choice, bits, i, j, side, fp in _units(batches):
            keys = np.stack([bits, i.astype(np.int64), j.astype(np.int64)])
            unit = np.append(0, np.cumsum(np.any(keys[:, 1:] != keys[:, :-1], axis=0)))
            size = np.bincount(unit)
            some = size[unit] > 1  # a row alone in its unit has no pair
            if not some.any():
                continue
            unit, fp, side, cross = unit[some], fp[some], side[some], (i != j)[some]
            roots = np.arange(len(fp))
            for u, v in linked(fp.view(np.uint64), unit, side, cross, chosen[int(choice[0])], radius):
                roots = _joined(roots, u, v)
            at = np.flatnonzero(roots != np.arange(len(roots)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[roots[at]])], names=["a", "b"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, full: int = FULL, block: int = BLOCK) -> DataFrame:
    """a, b: trees that join all fingerprints whose chains of links meet; nodes has each fp once."""
    chosen = masks(nodes.count(), radius, full)
    units = in_units(bucket_rows(nodes, chosen), block)
    units = units.repartition("choice", "bits", "i", "j").sortWithinPartitions("choice", "bits", "i", "j")
    return arrow_map(units, _trees(chosen, radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, fp, component_id of every row."""
    rows = written(fingerprints(docs, id_col, text), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    roots = written(components(links(nodes.select("fp"), radius), "a", "b"), "roots")
    least = written(roots.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    moved = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked"))
    # written, so that both sides below are dealt out anew and the rows of a hot fingerprint can be split
    named = nodes.join(moved, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    named = written(named, "components")
    for t in (nodes, roots, least):
        drop(t)
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
