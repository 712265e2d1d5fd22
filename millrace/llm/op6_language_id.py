"""Language identification: family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams around the letters of the whole text, as shares of all
its trigrams, so a linear score is the mean of the trigrams' weights and no feature
vector is built when scoring.  Weights are whole numbers of a unit, so their sums are
exact and a text's prediction doesn't depend on what is read beside it.  Families are
separated one against another by linear SVMs, and so are the languages of a family, whose
duels are fought for the texts of that family only; votes decide, then margins.

The fit takes the documents with the smallest hashes: ``PER_LANGUAGE`` of each language and
``MAX_ROWS`` in all at most, which bounds what the driver gets; more than ``MAX_LANGUAGES``
languages are an error, which bounds the model.  Scoring reads all documents.

Defined results: ``und`` with score 0 for null texts and texts without a letter; if
nothing could be learned every prediction is ``und``.  Rows without text or language
teach nothing, nor do rows without id; of the texts of equal id and language the one with the
least hash is learned from, once.
Repeated rows are predicted alike, texts of any length as a whole; an empty table gives
no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .op1_quality_classifier import held_out
from .textcore import Block, arrow_map, blocks, offsets_of, ragged, table

PER_LANGUAGE, MAX_ROWS, MAX_LANGUAGES = 600, 4800, 160
#: Texts whose trigrams are counted at once for a fit.
FIT_ROWS = 512
BITS = 12
#: The slot of places without a letter, whose weight is 0.
NO_SLOT = 1 << BITS

# Families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky tt",
    "semitic": "ar he mt am",
    "indic": "hi bn pa mr gu ur ne si or as",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "celtic": "ga gd cy br",
    "sinitic": "zh yue",
    "malayic": "id ms jv su",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_MAP = np.full(256, 0x20, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def trigrams(blk: Block) -> np.ndarray:
    """Slot of the trigram around every byte of the block; ``NO_SLOT`` where the byte is of no letter."""
    d = np.full(len(blk.data) + 2, 0x20, np.uint8)  # a blank on both sides: documents never see each other
    d[1:-1] = _MAP[blk.data]
    on = d[1:-1] != 0x20
    d = d.astype(np.uint32)
    t = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
    return np.where(on, ((t * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), NO_SLOT)


def has_letter(blk: Block) -> np.ndarray:
    ascii_letter = (_MAP[blk.data] >= 97) & (_MAP[blk.data] < 123)
    out = np.add.reduceat(ascii_letter, blk.bounds[:-1], dtype=np.int64) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in blk.data[blk.doc_start[i] : blk.doc_end[i]].tobytes().decode())
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient; y is 1 or -1, classes weighted alike."""
    n = len(y)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c
    b = np.column_stack([x, np.ones(n)])
    v = np.ones(b.shape[1])
    for _ in range(12):  # power iteration for the step size
        v = b.T @ (weight * (b @ v))
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (1e-2 + 2.2 * float(v @ (b.T @ (weight * (b @ v)))))
    w, z, t = np.zeros(b.shape[1]), np.zeros(b.shape[1]), 1.0
    for _ in range(steps):
        miss = np.maximum(0, 1 - y * (b @ z))
        g = 1e-2 * np.append(z[:-1], 0) - 2 * (b.T @ (weight * miss * y))
        new, t2 = z - rate * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


@dataclass
class Duels:
    """One-versus-one decisions among names; columns are their places in the weight matrix."""

    names: list[str]
    pairs: list[tuple[int, int, int]]

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        votes = np.zeros((len(margins), len(self.names)))
        total = np.zeros_like(votes)
        least = np.full(votes.shape, np.inf)
        for a, b, col in self.pairs:
            m = margins[:, col]
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            total[:, a] += np.tanh(m)
            total[:, b] -= np.tanh(m)
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = (votes + 1e-3 * total).argmax(1)
        return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(best)), best], -20, 20)))


@dataclass
class LanguageModel:
    weights: np.ndarray  #: int32, a row for each duel, a column for each trigram slot and a 0 for NO_SLOT
    unit: float  #: what a weight of 1 is worth
    bias: np.ndarray
    families: Duels | None
    within: list[Duels]

    def margins(self, slot: np.ndarray, bounds: np.ndarray, duels: Duels) -> np.ndarray:
        """Margins of these duels, in their columns, for texts slot[bounds[i]:bounds[i+1]]."""
        out = np.zeros((len(bounds) - 1, len(self.bias)))
        n = np.maximum(np.add.reduceat(slot != NO_SLOT, bounds[:-1], dtype=np.int64), 1)
        for _, _, k in duels.pairs:
            out[:, k] = np.add.reduceat(self.weights[k][slot], bounds[:-1], dtype=np.int64) * self.unit / n + self.bias[k]
        return out

    def predict(self, blk: Block) -> tuple[list[str], np.ndarray]:
        known = has_letter(blk)
        if self.families is None:
            return ["und"] * blk.n, np.zeros(blk.n)
        slot, bounds = trigrams(blk), blk.bounds
        family, score = self.families.decide(self.margins(slot, bounds, self.families))
        out, conf = np.full(blk.n, "und", object), np.zeros(blk.n)
        for f, duels in enumerate(self.within):
            at = np.flatnonzero((family == f) & known)
            if not len(at):
                continue
            size = np.diff(bounds)[at]
            own = slot[ragged(bounds[at], size)] if duels.pairs and len(at) < blk.n else slot
            lang, sure = duels.decide(self.margins(own, offsets_of(size), duels) if duels.pairs else np.zeros((len(at), 0)))
            out[at] = np.array(duels.names, object)[lang]
            conf[at] = score[at] * sure
        return out.tolist(), conf


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> LanguageModel:
    """Fits on doc_id, text, lang of the given documents."""
    n_langs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).agg(F.count_distinct("lang")).first()[0]
    if n_langs > MAX_LANGUAGES:
        raise ValueError(f"{n_langs} languages; {MAX_LANGUAGES} at most")
    per_language = min(per_language, max(max_rows // max(n_langs, 1), 1))
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("t"), F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 40)).alias("h"))
    # a count of each language's ids tells below which hash some more than enough of them lie
    counts = F.broadcast(rows.groupBy("lang").agg((F.lit(float(1 << 40)) * 2.5 * per_language / F.approx_count_distinct("doc_id")).alias("below")))  # a row for each language
    rows = rows.join(counts, "lang").where("h < below").groupBy("doc_id", "lang", "h").agg(F.min("t").alias("t"))  # of an id's texts one
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = rows.withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id", "lang", "t")  # per_language rows a language
    texts = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("t")).join(F.broadcast(chosen), ["doc_id", "lang", "t"])
    texts = texts.groupBy("doc_id", "lang").agg(F.first("text").alias("text")).select("text", "lang")  # rows that are repeated whole count once

    def count(batches):
        for batch, whole in blocks(batches):
            slots, bounds = trigrams(whole), whole.bounds
            for a in range(0, whole.n, FIT_ROWS):  # a dense row for each text
                z = min(a + FIT_ROWS, whole.n)
                slot, n = slots[bounds[a] : bounds[z]], z - a
                on = slot != NO_SLOT
                doc = np.repeat(np.arange(n), np.diff(bounds[a : z + 1]))
                flat = np.bincount(doc[on] * NO_SLOT + slot[on], minlength=n * NO_SLOT).reshape(n, -1)
                share = (flat / np.maximum(flat.sum(1, keepdims=True), 1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, n), pa.array([r.tobytes() for r in share], pa.binary())], names=["lang", "x"])

    got = arrow_map(texts, count, "lang string, x binary").toPandas().sort_values(["lang", "x"], ignore_index=True)
    langs = sorted(set(got["lang"]))
    if not langs:
        return LanguageModel(np.zeros((0, NO_SLOT + 1), np.int32), 1.0, np.zeros(0), None, [])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(np.float32)
    scale = 1 / np.maximum(x.std(0), 1e-4)
    x = x * scale / np.sqrt(x.shape[1])
    scale = scale / np.sqrt(x.shape[1])
    lang = got["lang"].to_numpy()
    fam = np.array([FAMILY.get(c, c) for c in lang])
    weights, bias = [], []

    def duels(names: list[str], of: np.ndarray) -> Duels:
        pairs = []
        for a, b in combinations(range(len(names)), 2):
            at = (of == names[a]) | (of == names[b])
            w, c = linear_svm(x[at], np.where(of[at] == names[a], 1.0, -1.0))
            pairs.append((a, b, len(bias)))
            weights.append(w * scale)
            bias.append(c)
        return Duels(names, pairs)

    names = sorted(set(fam))
    families = duels(names, fam)
    within = [duels([c for c in langs if FAMILY.get(c, c) == f], lang) for f in names]
    w = np.array(weights, float).reshape(-1, NO_SLOT)
    unit = max(float(np.abs(w).max()) / (1 << 30), 1e-30) if w.size else 1.0
    return LanguageModel(np.column_stack([np.rint(w / unit), np.zeros(len(w))]).astype(np.int32), unit, np.array(bias), families, within)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, lang_pred, score."""

    def run(batches):
        for b, blk in blocks(batches):
            lang, score = model.predict(blk)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return arrow_map(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("text")), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
