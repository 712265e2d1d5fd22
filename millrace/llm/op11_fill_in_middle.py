"""Fill-in-middle transformation over arrays of code points.

Each text becomes a UTF-32 array.  Its code points have classes, and a unit ends where the
class of a neighbour differs (``flatnonzero`` of the comparison), so the units of a text are
known by their bounds.  Two hashes of the id choose two of those bounds by rank; the pieces
are slices of the array, encoded again, and put in the order of the chosen form:

- ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
- ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
- ``plain``: the text as it is

``restore`` rebuilds the text from output and form alone.  A marker can't arise across the
border of a piece, and a text that holds one stays plain, so that is exact.

Units are code points (``unit="codepoint"``: neighbours differ by parity of place) or runs of
letters, digits, white space or other (``unit="run"``).

Defined results: null and empty texts are plain, of length 0.  A null id counts as the empty
string where hashes are made.  Repeated ids are cut at the same ranks, repeated rows come out
once each.  Bytes that are no UTF-8 count as one unit each and come back as they were.  Texts
of any length are cut whole, one at a time.  Columns of other names are not read by ``query``;
``transform`` carries ``keep`` through and refuses names that it adds itself.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import arrow_map, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 texts so many become one of the two forms, and of 100 of those so many spm.
CUT_PERCENT, SPM_PERCENT = 90, 20
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def codepoints(raw: bytes) -> np.ndarray:
    """UTF-32 array of a text; a byte that is no UTF-8 becomes one lone surrogate."""
    return np.frombuffer(raw.decode(errors="surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def encoded(points: np.ndarray) -> bytes:
    """The reverse of ``codepoints``."""
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode(errors="surrogateescape")


def _ascii_classes() -> np.ndarray:
    out = np.full(128, 3, np.uint8)
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 0
    out[0x30:0x3A] = 1
    out[[0x20, *range(0x09, 0x0E)]] = 2
    return out


_CLASSES = _ascii_classes()


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """Class of each code point; beyond ASCII all count as letters."""
    if unit == "codepoint":
        return np.arange(len(points)) & 1
    if unit == "run":
        return np.where(points < 128, _CLASSES[np.minimum(points, 127)], 0)
    raise ValueError(unit)


def bounds_of(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the text's length; of an empty text only 0."""
    c = classes(points, unit)
    inner = np.flatnonzero(c[1:] != c[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draws(doc_id: object, seed: int = 1) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of an id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[4 * k : 4 * k + 4], "big") for k in range(4))


def cut(raw: bytes, doc_id: object, unit: str = "codepoint", seed: int = 1) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (none if plain), and output of one text."""
    points = codepoints(raw)
    bounds = bounds_of(points, unit)
    n = len(bounds) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= CUT_PERCENT or any(m in raw for m in MARKS):
        return n, "plain", None, None, raw
    a, b = bounds[sorted((h1 % (n + 1), h2 % (n + 1)))]
    prefix, middle, suffix = (encoded(points[i:j]) for i, j in ((0, a), (a, b), (b, len(points))))
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", int(a), int(b - a), b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", int(a), int(b - a), b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text, from output and form."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"the output does not begin with {first.decode()}")
    one, two = output.index(second), output.index(MIDDLE)
    pieces = {first: output[len(first) : one], second: output[one + len(second) : two]}
    return pieces[PREFIX] + output[two + len(MIDDLE) :] + pieces[SUFFIX]


def _cuts(batch: pa.RecordBatch, id_col: str, unit: str, seed: int) -> Iterator[tuple]:
    """``cut`` of every row, one text at a time."""
    ids, texts = batch.column(id_col), batch.column("text").cast(pa.binary())
    for k in range(batch.num_rows):
        yield cut(texts[k].as_py() or b"", ids[k].as_py(), unit, seed)


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: str = "codepoint", seed: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns ``keep``, and n, form, prefix_chars, middle_chars, output of each row."""
    if clash := {id_col, *keep} & {*ADDED, "text"}:
        raise ValueError(f"names that the result uses itself: {sorted(clash)}")
    fields = [docs.schema[c] for c in (id_col, *keep)]

    def run(batches):
        for b in batches:
            cuts = [*_cuts(b, id_col, unit, seed)]
            cols = [pa.array(x, t) for x, t in zip(zip(*cuts, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)] if cuts else []
            if cuts:
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), *cols[:-1], cols[-1].cast(pa.string())], names=[*(f.name for f in fields), *ADDED])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"])
    return arrow_map(docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{text}`").alias("text")), run, schema)


def restored(cuts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col and the text that ``transform`` was given, from output and form."""

    def run(batches):
        for b in batches:
            outputs, forms = b.column("output").cast(pa.binary()), b.column("form")
            texts = pa.array([restore(outputs[k].as_py(), forms[k].as_py()) for k in range(b.num_rows)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=[id_col, "text"])

    kind = cuts.schema[id_col].dataType.simpleString()
    return arrow_map(cuts.select(F.col(f"`{id_col}`"), "output", "form"), run, f"`{id_col}` {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the outputs, and of the texts rebuilt from them."""

    def run(batches):
        for b in batches:
            outputs, forms = b.column("output").cast(pa.binary()), b.column("form")
            out, back = [], []
            for k in range(b.num_rows):
                x = outputs[k].as_py()
                out.append(hashlib.sha256(x).hexdigest())
                back.append(hashlib.sha256(restore(x, forms[k].as_py())).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string()), pa.array(back, pa.string())], names=[*b.schema.names[:-1], "output_sha256", "restored_sha256"])

    cuts = transform(table(spark, sf_dir, "documents"))
    kind = cuts.schema["doc_id"].dataType.simpleString()
    return arrow_map(cuts, run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")
