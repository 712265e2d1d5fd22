"""Token ids as binary output: a wavelet matrix per shard.

Documents are dealt out by ranges of doc_id and sorted; each task cuts its run of
documents into shards of about ``SHARD_TOKENS`` ids, whole documents each, and makes
one file image of each (format: ``wavelet``).  Spark writes the images, so that any
store it can write to will do and a lost task's files are never seen; ``export``
puts them into plain files.  Reading back gives every document's ids and its place
in the whole sequence, from sums over the shards before it.

Defined results: null text is empty, so its document is the end id alone; documents
of equal id stand in order of their text; null ids come first; repeated rows are documents
each.  A text of any length is whole, in one shard.  An empty table gives no documents.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wavelet
from .pretokens import Memo, joinable
from .store import scratch_path
from .textcore import arrow_map, blocks, ragged, table

SHARD_TOKENS = 1 << 20
#: Chunks that the library gets as one text.
PIECE = 256
SHARDS = "part int, shard int, base bigint, n_tokens bigint, payload binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class LibraryEncoder:
    """Ids of blocks by the tokenizers library, which sees each distinct chunk once."""

    _kept: dict[str, LibraryEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.bits = max(1, (self.size - 1).bit_length())
        self.width = np.zeros(self.size, np.int64)
        for s, i in vocab.items():
            self.width[i] = len(s)  # a byte-level token has a character for each byte
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.memo = Memo(dtype=np.uint16 if self.bits <= 16 else np.uint32)

    @classmethod
    def of(cls, path: str) -> LibraryEncoder:
        """The worker's encoder for a tokenizer file, kept from task to task."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def new(self, blk, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        together = joinable(blk, s, e)
        n = e - s
        joined = blk.data[ragged(s[together], n[together])].tobytes()
        cuts = np.append(0, np.cumsum(n[together]))
        cuts = np.append(cuts[:-1:PIECE], cuts[-1]).tolist()
        texts = [joined[a:z].decode() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        flat = np.array([i for x in self.tok.encode_batch_fast(texts, add_special_tokens=False) for i in x.ids], np.int64)
        lens = np.zeros(len(s), np.int64)
        bounds = np.searchsorted(np.append(0, np.cumsum(self.width[flat])), np.append(0, np.cumsum(n[together])))
        lens[together] = np.diff(bounds)
        raw = blk.data.tobytes()
        alone = np.flatnonzero(~together)
        got = [x.ids for x in self.tok.encode_batch_fast([raw[s[i] : e[i]].decode() for i in alone], add_special_tokens=False)]
        lens[alone] = [len(x) for x in got]
        out = np.zeros(int(lens.sum()), self.memo.store.dtype)
        at = np.append(0, np.cumsum(lens))[:-1]
        out[ragged(at[together], lens[together])] = flat
        out[ragged(at[alone], lens[alone])] = [i for x in got for i in x]
        return out, lens

    def encode(self, blk) -> tuple[np.ndarray, np.ndarray]:
        return self.memo.encode(blk, self.added, self.new)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes the shards of all documents in order of id to ``path``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches):
        enc = LibraryEncoder.of(tokenizer)
        part, shard, base = TaskContext.get().partitionId(), 0, 0
        ids, lens, docs_, held = [], [], [], 0

        def image():
            n = np.concatenate(lens)
            return pa.record_batch([pa.array([v], t) for v, t in ((part, pa.int32()), (shard, pa.int32()), (base, pa.int64()), (held, pa.int64()), (wavelet.encode(np.concatenate(ids), enc.bits, docs_, np.cumsum(n)), pa.binary()))], names=["part", "shard", "base", "n_tokens", "payload"])

        for b, blk in blocks(batches):
            flat, bounds = enc.encode(blk)
            n = np.diff(bounds)
            whole = np.full(len(flat) + blk.n, end_id, flat.dtype)  # each document's ids, then the end id
            keep = np.ones(len(whole), bool)
            keep[np.cumsum(n + 1) - 1] = False
            whole[keep] = flat
            ids.append(whole)
            lens.append(n + 1)
            docs_ += b.column("id").to_pylist()
            held += len(whole)
            if held >= SHARD_TOKENS:
                yield image()
                shard, base = shard + 1, base + held
                ids, lens, docs_, held = [], [], [], 0
        if docs_:
            yield image()

    arrow_map(rows, run, SHARDS).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each task that wrote
    before = dict(zip([r["part"] for r in totals], np.append(0, np.cumsum([r["n"] for r in totals]))[:-1].tolist(), strict=True)) if totals else {}

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                w = wavelet.WaveletMatrix(b.column("payload")[r].as_buffer())
                raw = w.tokens().astype("<u4")
                starts = np.append(0, w.ends)[:-1]
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(starts, w.ends, strict=True)]
                at = starts + (before[b.column("part")[r].as_py()] + b.column("base")[r].as_py())
                yield pa.record_batch([pa.array(w.doc_ids, pa.int64()), pa.array(at), pa.array(w.ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(shards, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def export(shards: DataFrame, folder: str) -> int:
    """Copies shards to plain files of a local folder, one at a time; returns how many."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in shards.orderBy("part", "shard").toLocalIterator():
        with open(f"{folder}/shard-{r['part']:05d}-{r['shard']:05d}.mrw", "wb") as f:
            f.write(r["payload"])
        n += 1
    return n


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_shards(spark, path)
