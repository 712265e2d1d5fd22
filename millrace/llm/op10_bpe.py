"""BPE encoding and decoding over a minimal acyclic transducer lexicon.

All words of all documents, each with the blank before it, are counted (pre-aggregated
in the workers, then by Spark); the ``LEXICON`` most frequent ones with at least
``MIN_COUNT`` occurrences are encoded once and compiled into the transducer, which
bounds its size.  It lies in the shared folder, Spark takes it to each executor, and all
workers there map the same file.  Every word walks through it first; one that it lacks is
merged exactly.  A document's ids decode to the document's very bytes.

Defined results: null and empty texts have no ids; strings of added tokens in a text
become their ids; repeated rows are encoded each; ids of documents may be null.  Texts
of any length are encoded whole, one that is longer than a block as a block of its own.
Other columns of the input are not read, whatever their names.  An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BytePairEncoder
from .lexicon import Lexicon, build
from .pretokens import chunks
from .store import drop, shipped, written
from .textcore import arrow_map, blocks, offsets_of, segment_sum, table

#: Words of the lexicon, at most, and the occurrences that a word of it has, at least.
LEXICON, MIN_COUNT = 1 << 15, 4
#: Longer words stay out of the lexicon.
MAX_BYTES = 32
_SLOT_BITS = 19


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _counted(batches, added: list[bytes]):
    """Words with the blank before them, counted; a word may come in several rows."""
    whole = lambda w, n: [x.ljust(k, b"\0") for x, k in zip(w.tolist(), n.tolist(), strict=True)]
    keys = np.zeros(1 << _SLOT_BITS, np.uint64)
    counts = np.zeros(1 << _SLOT_BITS, np.int64)
    words = np.zeros(1 << _SLOT_BITS, f"S{MAX_BYTES}")
    sizes = np.zeros(1 << _SLOT_BITS, np.int64)  # since such an array takes NULs at the end of a word for padding
    for _, blk in blocks(batches):
        s, e, _ = chunks(blk, added)
        s = s[(at := e - s <= MAX_BYTES)]
        e = e[at]
        h = blk.hash_spans(s, e)
        h, first, n = np.unique(h, return_index=True, return_counts=True)
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        lead = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.zeros(0, bool)  # hashes are sorted, so slots are
        slot, one, rest = slot[lead], np.flatnonzero(lead), np.flatnonzero(~lead)
        h1, n1, f1 = h[one], n[one], first[one]
        same = keys[slot] == h1
        counts[slot[same]] += n1[same]
        out = slot[~same]
        old = counts[out] > 0
        raw = blk.data.tobytes()
        spans = lambda f: [raw[a:z] for a, z in zip(s[f], e[f], strict=True)]
        gone, gone_counts = whole(words[out[old]], sizes[out[old]]), counts[out[old]]
        put = f1[~same]
        keys[out], counts[out], words[out], sizes[out] = h1[~same], n1[~same], np.array(spans(put), f"S{MAX_BYTES}"), (e - s)[put]
        c = np.concatenate([gone_counts, n[rest]])
        yield pa.record_batch([pa.array(gone + spans(first[rest]), pa.binary()), pa.array(c, pa.int64())], names=["word", "n"])
    live = np.flatnonzero(counts)
    for a in range(0, len(live), 1 << 16):
        at = live[a : a + (1 << 16)]
        yield pa.record_batch([pa.array(whole(words[at], sizes[at]), pa.binary()), pa.array(counts[at], pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, tokenizer: str, limit: int = LEXICON, least: int = MIN_COUNT, text: str = "text") -> list[bytes]:
    """The most frequent words: all at or above the lowest level of counts (16 levels for each factor of e) that at most ``limit`` words reach."""

    def count(batches):
        yield from _counted(batches, BytePairEncoder.of(tokenizer).added_bytes)

    counted = arrow_map(docs.select(F.col(f"`{text}`").alias("text")), count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    kept = written(counted.where(F.col("n") >= least).select("word", F.floor(F.ln("n") * 16).cast("int").alias("level")), "words")
    levels = sorted(((r["level"], r["count"]) for r in kept.groupBy("level").count().collect()), reverse=True)  # some hundred rows
    total, low = 0, None
    for level, n in levels:
        if (total := total + n) > limit:
            break
        low = level
    words = [] if low is None else [bytes(r["word"]) for r in kept.where(F.col("level") >= low).collect()]  # at most limit rows
    drop(kept)
    return sorted(words)


def compile_lexicon(words: list[bytes], tokenizer: str) -> bytes:
    """Transducer from words, as they stand in texts, to their ids."""
    enc = BytePairEncoder.of(tokenizer)
    words = sorted({*words} - {b""})
    data, lens, special, count = enc.pretokens([w.decode() for w in words])
    ids, n = enc.encode_pretokens(data, lens, special)
    return build(words, ids, segment_sum(n, offsets_of(count)))


def encoder(tokenizer: str, image: str) -> BytePairEncoder:
    """The worker's encoder with the lexicon of that file, which Spark has brought here."""
    enc = BytePairEncoder.of(tokenizer)
    if getattr(enc, "image", None) != image:
        enc.lexicon, enc.image = Lexicon(SparkFiles.get(image)), image
    return enc


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if wanted."""
    image = shipped(docs.sparkSession, compile_lexicon(frequent_words(docs, tokenizer, text=text), tokenizer), "lexicon")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer, image)
        for b, blk in blocks(batches):
            flat, bounds = enc.encode(blk)
            raw = flat.astype("<u4")
            data, at = enc.decode(flat, bounds)
            sha = [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            back = [hashlib.sha256(data[a:z].tobytes().decode(errors="replace").encode()).hexdigest() for a, z in zip(at[:-1], at[1:], strict=True)]
            cols = [b.column(0), pa.array(np.diff(bounds)), pa.array(sha), pa.array(back)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(raw.view("<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return arrow_map(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("text")), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode(docs, tokenizer_path())
