"""Quality classifier: a sparse rule ensemble.

Shallow trees are grown on random halves of a bounded labelled sample; every path
from a root is a conjunctive rule over text statistics.  Lasso logistic regression
gives the rules weights, most of them 0, and the rules that are left are compiled
into one Spark column expression, which code generation turns into plain JVM code.

Defined results: null and empty texts have statistics of 0 and are scored like any
other.  Without labels of both kinds every score is the share of label 1 (0.5 if
there are none).  A null doc_id is never held out and never learned from; repeated rows are
scored alike, and of labelled rows of equal id and label the fit sees one.  Texts of any
length are read whole; an empty table gives no rows.  An input column with the name of a
statistic, score or predicted is dropped in favour of the one added.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .op9_quality_rules import MAX_LABELLED, sample_matrix, with_counts
from .stats import RATIOS
from .textcore import table

FEATURES = [*RATIOS, "n_words", "n_lines"]
Rule = tuple[tuple[int, bool, float], ...]  #: (feature, whether above, value) of each condition


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, seed: int = 3) -> list[Rule]:
    """Distinct root paths of small trees, each on half of the rows and of the features."""
    rng = np.random.default_rng(seed)
    found: dict[Rule, None] = {}

    def split(rows: np.ndarray, cols: np.ndarray) -> tuple[float, int, float] | None:
        best, n, total = None, len(rows), y[rows].sum()
        for f in cols:
            order = np.argsort(x[rows, f], kind="stable")
            v, c = x[rows[order], f], np.cumsum(y[rows[order]])[:-1]
            k = np.arange(1, n)
            gini = (c * (k - c) / k) + ((total - c) * ((n - k) - (total - c)) / (n - k))
            gini[v[1:] == v[:-1]] = np.inf
            if n > 1 and np.isfinite(gini).any():
                i = int(np.argmin(gini))
                if best is None or gini[i] < best[0] - 1e-12:
                    best = float(gini[i]), int(f), float((v[i] + v[i + 1]) / 2)
        return best

    def walk(rows: np.ndarray, path: Rule) -> None:
        if path:
            found[tuple(sorted(path))] = None
        if len(path) == depth or len(rows) < 10 or y[rows].min() == y[rows].max():
            return
        cols = rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False)
        if (s := split(rows, cols)) is not None:
            _, f, t = s
            walk(rows[x[rows, f] <= t], (*path, (f, False, t)))
            walk(rows[x[rows, f] > t], (*path, (f, True, t)))

    for _ in range(trees):
        walk(np.sort(rng.choice(len(x), max(2, len(x) // 2), replace=False)), ())
    return list(found)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, above, t in rule:
            out[:, j] *= (x[:, f] > t) == above
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept isn't penalised."""
    n, m = a.shape
    b = np.column_stack([np.ones(n), a])
    rate = 4 * n / max(np.linalg.norm(b, 2) ** 2, 1e-9)
    w, z, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(steps):
        g = b.T @ (1 / (1 + np.exp(-np.clip(b @ z, -40, 40))) - y) / n
        new = z - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    names: list[str] = field(default_factory=lambda: list(FEATURES))

    def column(self) -> Column:
        """The score as a Spark expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            cond = F.lit(True)
            for f, above, t in rule:
                c = F.col(self.names[f])
                cond = cond & ((c > F.lit(t)) if above else (c <= F.lit(t)))
            total = total + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed=None, limit: int = MAX_LABELLED, penalty: float = 0.002) -> RuleEnsemble:
    x, y = sample_matrix(docs, labels, label, FEATURES, allowed, limit)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        return RuleEnsemble(float(np.log(share / (1 - share))))
    rules = grow_rules(x, y)
    b, w = lasso_logistic(holds(rules, x), y.astype(float), penalty)
    live = [j for j in range(len(rules)) if abs(w[j]) > 1e-6]
    return RuleEnsemble(b, [rules[j] for j in live], [float(w[j]) for j in live])


def score(df: DataFrame, model: RuleEnsemble, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds the statistics, and score (0 to 1) and predicted (0 or 1)."""
    own = [c for c in df.columns if c not in ("score", "predicted")]
    return with_counts(df.select(*[F.col(f"`{c}`") for c in own]), text, keep_text).withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), allowed=lambda c: ~held_out(c, 3, 1))
    return score(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
