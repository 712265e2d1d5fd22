"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles, each partition twice as
wide as the one before.  For each partition documents are read as overlapping
windows of twice its largest size, so that a window and an item are of like size
and the Jaccard similarity of a contained item stays above 0.19 however long the
document is; with 64 one-row bands an item that is there meets a window with
probability 1 - 2e-6.  A candidate pair is verified by exact containment of the
item's shingles in the whole document.

A window can share a minimum with an item only if it holds that item's minimum
shingle, so windows without any of those shingles are skipped before a signature
is computed; this leaves the outcome as it is.

Items are handled in blocks of about ``ITEM_BYTES`` of text, which bounds what the driver
and a worker hold: each block is read, compared with all documents and let go, its result
written, before the next is read.

Words are lower-cased (ASCII and Latin-1 letters) and freed from ASCII punctuation.
Defined results: items without words are found nowhere; an item of 1 to 4 words is
one shingle of all its words; null texts are empty; repeated items and documents
give repeated rows; null ids are kept.  Shingles are compared by 64-bit hashes of their
words.  Texts of any length are searched whole.  Empty tables of documents or items give
no rows (the stage then keeps all documents).  Of the input only ids and texts are read;
``stage`` hands the other columns on untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sketch import permuted, signatures
from .store import written
from .textcore import SHINGLE, Block, arrow_map, blocks, distinct_by_segment, offsets_of, ragged, run_hashes, table

CONTAINMENT = 0.8
BANDS = 64
#: Text of the items that are compared at once.
ITEM_BYTES = 8 << 20
_TABLE_BITS = 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DROPPED = np.zeros(256, bool)
_DROPPED[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def normalised(blk: Block) -> Block:
    """The block in lower case and without ASCII punctuation."""
    data = _LOWER[blk.data]
    upper = np.zeros(len(data), bool)  # U+00C0-U+00DE but the multiplication sign
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[upper] += 0x20
    keep = ~_DROPPED[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    keep[blk.doc_end] = False
    ends = before[blk.doc_end] - np.arange(blk.n)
    return Block(data[keep], np.append(0, ends))


def runs(blk: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    return run_hashes(blk.word_hashes(), blk.words()[2], k, short=False)


@dataclass
class Part:
    """Items with runs of k words, and at most ``upper`` of them."""

    k: int
    upper: int
    items: np.ndarray  #: positions in the block of items
    bands: list[tuple[np.ndarray, np.ndarray]]  #: sorted minima and their items
    needed: np.ndarray  #: sorted shingles that are an item's minimum


class ItemIndex:
    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        arr = pa.array([t or "" for t in texts], pa.large_string())
        whole = pa.record_batch([arr], names=["text"])
        self.sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(ids)
        self.k = np.zeros(len(ids), int)
        at = 0
        for b, raw in blocks(iter([whole])):
            blk = normalised(raw)
            n_words = np.diff(blk.words()[2])
            for k in sorted({*np.minimum(n_words, SHINGLE)} - {0}):
                h, bounds = distinct_by_segment(*runs(blk, int(k)))
                for i in np.flatnonzero(np.minimum(n_words, SHINGLE) == k):
                    self.sets[at + i], self.k[at + i] = h[bounds[i] : bounds[i + 1]], k
            at += b.num_rows
        size = np.array([len(s) for s in self.sets])
        self.parts: list[Part] = []
        for k in sorted({*self.k} - {0}):
            live = np.flatnonzero(self.k == k)
            level = np.ceil(np.log2(np.maximum(size[live], 1))).astype(int)
            for p in sorted({*level}):
                items = live[level == p]
                flat, bounds = np.concatenate([self.sets[i] for i in items]), offsets_of(size[items])
                sig = signatures(flat, bounds, BANDS)
                bands, needed = [], []
                for b in range(BANDS):
                    order = np.argsort(sig[:, b], kind="stable")
                    bands.append((sig[order, b], items[order]))
                    needed.append(flat[permuted(flat, b) == np.repeat(sig[:, b], size[items])])
                self.parts.append(Part(int(k), 1 << int(p), items, bands, np.unique(np.concatenate(needed))))

    def pairs(self, raw: Block, containment: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, shared shingles) of the contained items of a block."""
        blk = normalised(raw)
        docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        streams: dict[int, tuple] = {}
        for part in self.parts:
            if part.k not in streams:
                streams[part.k] = runs(blk, part.k)
            h, bounds = streams[part.k]
            low = np.zeros(1 << _TABLE_BITS, bool)
            low[(part.needed >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            at = np.flatnonzero(low[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            at = at[np.isin(h[at], part.needed)]
            if not len(at):
                continue
            doc = np.searchsorted(bounds, at, "right") - 1
            w = (at - bounds[doc]) // part.upper
            doc, w = np.concatenate([doc, doc]), np.concatenate([w, w - 1])
            win = np.unique(np.column_stack([doc, w])[w >= 0], axis=0)
            doc, start = win[:, 0], bounds[win[:, 0]] + win[:, 1] * part.upper
            length = np.minimum(start + 2 * part.upper, bounds[doc + 1]) - start
            sig = signatures(h[ragged(start, length)], offsets_of(length), BANDS)
            for b, (minima, own) in enumerate(part.bands):
                a, z = np.searchsorted(minima, sig[:, b], "left"), np.searchsorted(minima, sig[:, b], "right")
                docs.append(np.repeat(doc, z - a))
                items.append(own[ragged(a, z - a)])
        found = np.unique(np.column_stack([np.concatenate(docs), np.concatenate(items)]), axis=0)
        shared = np.zeros(len(found), np.int64)
        held: tuple = (None, None, None)
        for r, (d, i) in enumerate(found):
            if held[:2] != (d, self.k[i]):
                h, bounds = streams[self.k[i]]
                held = d, self.k[i], np.unique(h[bounds[d] : bounds[d + 1]])
            shared[r] = np.isin(self.sets[i], held[2], assume_unique=True).sum()
        ok = shared >= containment * np.array([len(self.sets[i]) for i in found[:, 1]] or [0.0])[: len(found)] - 1e-9
        return found[ok, 0], found[ok, 1], shared[ok]


def item_blocks(items: DataFrame, id_col: str = "item_id", text: str = "text") -> tuple[int, Iterator[ItemIndex]]:
    """How many blocks all items make, and their indexes one by one, each over about ITEM_BYTES of text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    total = items.agg(F.sum(F.octet_length(t))).first()[0] or 0
    n = max(1, -(-total // ITEM_BYTES))
    rows = items.select(F.col(f"`{id_col}`").alias("id"), t.alias("text"))

    def each():
        for b in range(n):
            own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b) if n > 1 else rows
            got = sorted(own.collect(), key=lambda r: (r["id"] is not None, r["id"] if r["id"] is not None else 0, r["text"]))  # bounded by ITEM_BYTES
            yield ItemIndex([r["id"] for r in got], [r["text"] for r in got])

    return n, each()


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents and items they contain: id_col, item_id, n_shared, n_item, containment."""
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType
    schema = f"`{id_col}` {kinds[0]}, item_id {kinds[1].simpleString()}, n_shared bigint, n_item bigint, containment double"
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("text"))

    def search(index: ItemIndex) -> DataFrame:
        def run(batches):
            for b, blk in blocks(batches):
                d, i, shared = index.pairs(blk, containment)
                size = np.array([len(index.sets[x]) for x in i], np.int64)
                out = [b.column(0).take(pa.array(d)), pa.array([index.ids[x] for x in i]).cast(arrow_id), pa.array(shared), pa.array(size), pa.array(shared / np.maximum(size, 1))]
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "item_id", "n_shared", "n_item", "containment"])

        return arrow_map(rows, run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(kinds[1])
    n, indexes = item_blocks(items)
    return reduce(DataFrame.unionAll, [search(x) if n == 1 else written(search(x), "contained") for x in indexes])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    n, indexes = item_blocks(table(spark, sf_dir, "benchmark"))

    def clean(index: ItemIndex):
        def run(batches):
            for b, blk in blocks(batches):
                stays = np.ones(b.num_rows, bool)
                stays[index.pairs(blk, CONTAINMENT)[0]] = False
                yield b.filter(pa.array(stays))

        return run

    for index in indexes:
        docs = arrow_map(docs, clean(index), docs.schema)
        docs = docs if n == 1 else written(docs, "clean")
    return docs
