"""Quality rules: base limits, then an isolation forest on rule statistics.

``fit_rules`` draws a bounded sample of labelled rows (``MAX_LABELLED``) and fits the
forest on the rows labelled good, in the range of all labelled rows, so that the space
where only bad ones lie is cut off early.  The limit is set where the fewest labelled rows
that pass the base limits are judged wrongly, each good one scored by those trees only that
haven't seen it (a tree sees 256 rows, and half of them at most); bad rows are seen by no
tree.  ``judge`` adds the counts, ``base_failed``, ``anomaly`` and
``kept`` to any table.

Defined results: null and empty texts have counts of 0 and fail the base limits
(under 20 words).  Repeated rows and ids are judged row by row; of labelled rows of equal
id and label the fit sees one, that with the least statistics.  Without labels of both
kinds the limit is 1, so that only the base limits decide.  Texts of any length are read
whole; an empty table gives no rows.  Columns of the input keep their names; a clash with
an added name drops the input's column (``stage`` adds none and keeps all).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forest import IsolationForest
from .stats import COUNTS, RATIOS, arrow_counts, block_counts, ratios
from .textcore import arrow_map, blocks, bounded_sample, table

#: Labelled rows that a fit looks at, at most: those with the smallest hashes.
MAX_LABELLED = 8000
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
CONTRACT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds COUNTS and RATIOS of the text; an input column of such a name is dropped, and so is the text if it isn't to be kept."""
    added = {*COUNTS, *RATIOS} | ({text} if not keep_text else set())
    keep = [f for f in df.schema.fields if f.name not in added]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in RATIOS)])
    names = [f.name for f in keep]

    def run(batches):
        for b, blk in blocks(batches, text):
            c = block_counts(blk)
            r = ratios(c)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *arrow_counts(c, COUNTS), *(pa.array(r[:, k]) for k in range(len(RATIOS)))], names=[*names, *COUNTS, *RATIOS])

    return arrow_map(df.select(*[F.col(f"`{n}`") for n in names], *([] if keep_text else [F.col(f"`{text}`")])), run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed=None, limit: int = MAX_LABELLED) -> DataFrame:
    """Texts of at most ``limit`` labelled documents: doc_id, text, label; all texts of an id that several rows have, each once for a label."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        rows = rows.where(allowed(F.col("doc_id")))
    rows = bounded_sample(rows.select("doc_id", F.col(label).cast("int").alias("label")).distinct(), limit, "doc_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # bounded by limit


def sample_matrix(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], allowed=None, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    rows = with_counts(labelled_sample(docs, labels, label, allowed, limit), keep_text=False)
    got = rows.groupBy("doc_id", "label").agg(F.min(F.struct(*columns)).alias("x")).select("doc_id", "label", "x.*").toPandas()  # limit at most
    got = got.sort_values(["doc_id", "label", *columns], ignore_index=True)
    return got[columns].to_numpy(float), got["label"].to_numpy(int)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


@dataclass
class Rules:
    forest: IsolationForest | None
    limit: float = 1.0

    def verdict(self, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        failed = base_failed(c["n_words"], c["n_repeat_words"])
        score = self.forest.score(np.sqrt(ratios(c))) if self.forest else np.zeros(len(failed))
        return failed, score, ~failed & (score <= self.limit)


def fit_rules(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Rules:
    x, y = sample_matrix(docs, labels, "quality", ["n_words", "n_repeat_words", *RATIOS], limit=limit)
    failed = base_failed(x[:, 0], x[:, 1])
    rows, good = np.sqrt(x[:, 2:]), (y == 1) & (x[:, 0] >= MIN_WORDS)
    bad = (y == 0) & ~failed
    if good.sum() < 2 or not bad.any():
        return Rules(None)
    forest = IsolationForest().fit(rows[good], rows[x[:, 0] >= MIN_WORDS])
    passed = ~failed[good]
    s = np.concatenate([forest.score_unseen(rows[good])[passed], forest.score(rows[bad])])
    y = np.repeat([1, 0], [passed.sum(), bad.sum()])
    order = np.argsort(s, kind="stable")
    s, y = s[order], y[order]
    # judged bad from place k on: good rows there and bad rows before it are wrong
    wrong = np.cumsum(np.append(0, y == 0)) + (y == 1).sum() - np.cumsum(np.append(0, y == 1))
    wrong[1:-1][s[1:] == s[:-1]] = len(s) + 1  # equal scores are judged alike
    best = np.flatnonzero(wrong == wrong.min())[-1]  # of equal limits the one that keeps more
    limit_at = 1.0 if best == len(s) else float((s[best - 1] + s[best]) / 2) if best else float(s[0]) / 2
    return Rules(forest, limit_at)


def judge(df: DataFrame, rules: Rules, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds the CONTRACT counts, base_failed, anomaly and kept; leaves the text out if it isn't to be kept."""
    added = {*CONTRACT, "base_failed", "anomaly", "kept"} | ({text} if not keep_text else set())
    keep = [f for f in df.schema.fields if f.name not in added]
    names = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{c} bigint" for c in CONTRACT), "base_failed boolean, anomaly double, kept boolean"])

    def run(batches):
        for b, blk in blocks(batches, text):
            c = block_counts(blk)
            failed, score, kept = rules.verdict(c)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *arrow_counts(c, CONTRACT), pa.array(failed), pa.array(score), pa.array(kept)], names=[*names, *CONTRACT, "base_failed", "anomaly", "kept"])

    return arrow_map(df.select(*[F.col(f"`{n}`") for n in names], *([] if keep_text else [F.col(f"`{text}`")])), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), rules, keep_text=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their own columns."""
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    names = docs.columns

    def run(batches):
        for b, blk in blocks(batches):
            yield b.filter(pa.array(rules.verdict(block_counts(blk))[2]))

    return arrow_map(docs, run, docs.schema).select(*[F.col(f"`{n}`") for n in names])
