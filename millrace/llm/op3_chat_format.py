"""Chat formatting by token-level assembly.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Role and text are encoded on their
own, and the marks are spliced in as reserved ids beyond the vocabulary, which no text
can produce.  Loss masks come from prefix sums over +1 and -1 at the ends of assistant
texts.  Strings that would read as marks when the ids are shown as text are escaped: a
backslash goes between ``<`` (with any backslashes after it) and ``|``; taking one away
gives the content back.  Line feeds and backslashes of a role are escaped as well.

Turns are dealt out by ranges of conversation, turn, role and text, so a conversation of
very many turns is formatted by several tasks; ``seq`` numbers them all in that order.
Turns stream through, so a conversation of any length takes no more memory than a batch.
Only ``digests`` brings the turns of one conversation together, since a hash is of them all
in order.  Defined results: null texts and roles are empty; turns of equal number stand in
order of role, then text (null turns first); rows with a null conversation id are one
conversation; repeated rows are repeated turns; texts of any length are whole; an empty
table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BytePairEncoder
from .op10_bpe import tokenizer_path
from .textcore import Block, arrow_map, blocks, offsets_of, ragged, table, text_arrays

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_OPEN, _CLOSED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)) if "\\" in role else role


def _block_of(texts: list[str]) -> Block:
    return Block(*text_arrays(pa.array(texts, pa.large_string())))


class Template:
    """Assembles turns from a tokenizer's ids and two reserved ones, and reads them back."""

    def __init__(self, tokenizer: str):
        self.enc = BytePairEncoder.of(tokenizer)
        self.start, self.end = self.enc.size, self.enc.size + 1
        self.feed = int(self.enc.encode(_block_of(["\n"]))[0][0])
        marks = [START.encode(), END.encode()]
        self.len = np.append(self.enc.word_len, [len(m) for m in marks])
        self.at = offsets_of(self.len)
        self.bytes = np.append(self.enc.word_bytes, np.frombuffer(b"".join(marks), np.uint8))

    def assemble(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of turns, their bounds, and the loss mask."""
        n = len(roles)
        segments = [s for r, t in zip(roles, texts, strict=True) for s in (escape_role(r), escape(t))]
        ids, bounds = self.enc.encode(_block_of(segments))
        size = np.diff(bounds)
        role, text = size[0::2], size[1::2]
        out = offsets_of(role + text + 4)
        flat = np.empty(out[-1], np.int64)
        flat[out[:-1]], flat[out[:-1] + 1 + role] = self.start, self.feed
        flat[out[1:] - 2], flat[out[1:] - 1] = self.end, self.feed
        place = np.empty(2 * n, np.int64)
        place[0::2], place[1::2] = out[:-1] + 1, out[:-1] + 2 + role
        flat[ragged(place, size)] = ids
        loss = np.array([r == LOSS_ROLE for r in roles], bool)
        step = np.zeros(out[-1] + 1, np.int64)
        np.add.at(step, place[1::2][loss], 1)
        np.add.at(step, (place[1::2] + text)[loss], -1)
        return flat, out, np.cumsum(step)[:-1].astype(bool)

    def text(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.at[ids], self.len[ids])].tobytes()


def format_chats(chats: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, seq, ids array<int>, loss array<boolean>: a row for each turn; seq rises with conv_id, turn, role and text."""
    kind = chats.schema["conv_id"].dataType.simpleString()
    rows = chats.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        template, seq = Template(tokenizer), TaskContext.get().partitionId() << 40
        for b, blk in blocks(batches):
            ids, bounds, loss = template.assemble(b.column("role").to_pylist(), b.column("text").to_pylist())
            off = pa.array(bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(seq + np.arange(blk.n)), pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(loss))], names=["conv_id", "turn", "seq", "ids", "loss"])
            seq += blk.n

    return arrow_map(rows, run, f"conv_id {kind}, turn bigint, seq bigint, ids array<int>, loss array<boolean>")


def _pieces(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw, at = data.tobytes(), bounds.tolist()
    return [raw[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each conversation, read back from the ids and masks alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = formatted.select("conv_id", "seq", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches):
        template = Template(tokenizer)
        head, tail = len(START), len(END) + 1
        conv, state, done, types = None, None, [], None

        def close():
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            out = pa.record_batch([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names=names)
            done.clear()
            return out

        for b in batches:
            types = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            if not b.num_rows:
                continue
            ids = b.column("ids").flatten().to_numpy()
            loss = b.column("loss").flatten().to_numpy(zero_copy_only=False)
            bounds = offsets_of(np.asarray(b.column("ids").value_lengths()))
            if (ids[bounds[:-1]] != template.start).any() or (ids[bounds[1:] - 2] != template.end).any():
                raise ValueError("a turn without its marks")
            n = template.len[ids]  # bytes of each id
            at = offsets_of(n)
            data = template.bytes[ragged(template.at[ids], n)]
            chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[at[bounds]]
            under = np.repeat(loss, n)
            learned = _pieces(data[under], np.append(0, np.cumsum(np.where(loss, n, 0)))[bounds])
            for k, (own, turn, text) in enumerate(zip(b.column("conv_id").to_pylist(), _pieces(data, at[bounds]), learned, strict=True)):
                if state is None or own != conv:
                    if state is not None:
                        close()
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, _, said = turn[head:-tail].decode().partition("\n")
                state[0] += 1
                state[1].update(f"{unescape_role(role)}\n{unescape(said)}\n".encode())
                if text:
                    plain = unescape(text.decode())
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += int(chars[k + 1] - chars[k])
            if done:
                yield flush()
        if state is not None:
            close()
            yield flush()

    return arrow_map(rows, run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = END + START + "assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_chats(chats, tokenizer_path()), tokenizer_path())
