"""Statistics, rules, weights, forest and verdict, each against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import op1_quality_classifier as op1
from millrace.llm import op6_language_id as op6
from millrace.llm import op9_quality_rules as op9
from millrace.llm import stats, textcore
from millrace.llm.forest import IsolationForest, expected_path

TEXTS = ["", " \n\t", "Ab! cd-EF 12 12 12\n\nx x\nx x\n", "É à Ü !!\nNEIN nein NEIN NEIN", "a\x0bb\x0cb\rb", "<|x|> #$%&* __ ~~", "ü" * 50 + " 9" * 50, "same line here\nother\nsame line here\nsame line here\n \n "]


def counts_by_hand(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    return {
        "n_chars": len(t), "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": sum(x in lines[:k] for k, x in enumerate(lines)), "n_repeat_words": len({k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}),
        "n_lines": len(lines), "n_upper": sum("A" <= c <= "Z" for c in t), "n_letters": sum(c.isascii() and c.isalpha() or c > "\x7f" for c in t), "n_digits": sum("0" <= c <= "9" for c in t),
        "n_bangs": t.count("!"), "n_punct": sum(c.isascii() and 32 < ord(c) < 127 and not c.isalnum() for c in t), "n_same_next": sum(a == b for a, b in zip(w, w[1:], strict=False)),
    }


def ratios_by_hand(c):
    part = lambda a, b: c[a] / max(c[b], 1)
    return [part("n_symbols", "word_chars"), part("n_upper", "n_letters"), part("n_bangs", "word_chars"), part("n_digits", "word_chars"), part("n_punct", "word_chars"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"), part("n_same_next", "n_words"), part("word_chars", "n_words")]


def test_all_counts_and_ratios(docs):
    texts = TEXTS + [r["text"] for r in docs.limit(60).collect()]
    got = [(blk, stats.block_counts(blk)) for _, blk in textcore.blocks(iter([pa.record_batch([pa.array(texts)], names=["text"])]))]
    have = {k: np.concatenate([c[k] for _, c in got]) for k in stats.COUNTS}
    want = [counts_by_hand(t) for t in texts]
    for k in stats.COUNTS:
        assert have[k].tolist() == [w[k] for w in want], k
    assert np.allclose(stats.ratios(have), [ratios_by_hand(w) for w in want])


def test_rules_of_trees():
    rng = np.random.default_rng(4)
    x = rng.random((200, 4)).round(2)
    y = ((x[:, 1] > 0.4) & (x[:, 3] <= 0.7)).astype(int)
    rules = op1.grow_rules(x, y)
    assert len({*rules}) == len(rules) and all(0 < len(r) <= 3 for r in rules)
    held = op1.holds(rules, x)
    for j, rule in enumerate(rules):
        assert held[:, j].tolist() == [float(all((row[f] > t) == above for f, above, t in rule)) for row in x]
    # a root split is where plain Gini impurity is least, over that tree's rows and columns
    draws = np.random.default_rng(3)
    rows, cols = np.sort(draws.choice(200, 100, replace=False)), draws.choice(4, 2, replace=False)
    best = None
    for f in cols:
        for t in sorted({(a + b) / 2 for a, b in zip(sorted({*x[rows, f]}), sorted({*x[rows, f]})[1:], strict=False)}):
            sides = [y[rows[x[rows, f] <= t]], y[rows[x[rows, f] > t]]]
            gini = sum(len(s) * s.mean() * (1 - s.mean()) for s in sides)
            if best is None or gini < best[0] - 1e-9:
                best = gini, int(f), t
    first = [r for r in rules if len(r) == 1][0][0]
    assert (first[0], first[2]) == (best[1], pytest.approx(best[2]))


def test_lasso_weights_meet_their_conditions():
    rng = np.random.default_rng(6)
    a = (rng.random((400, 30)) > 0.6).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * a[:, 0] - 3 * a[:, 1] + 0.5)))).astype(float)
    penalty = 0.02
    b, w = op1.lasso_logistic(a, y, penalty, steps=4000)
    miss = 1 / (1 + np.exp(-(b + a @ w))) - y
    g = a.T @ miss / len(y)
    assert abs(miss.mean()) < 1e-5 and 0 < (w == 0).sum() < 30
    assert np.all(np.abs(g[w == 0]) <= penalty + 1e-5)
    assert np.allclose(g[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5)


def path_by_hand(forest, row, root):
    at = root
    while forest.left[at] != at:
        at = forest.left[at] if row[forest.column[at]] <= forest.value[at] else forest.right[at]
    return forest.path[at]


def test_forest_row_by_row():
    rng = np.random.default_rng(9)
    x = rng.random((300, 5))
    x[:, 4] = 1.0
    forest = IsolationForest(trees=20, sample=64, depth=6).fit(x, np.vstack([x, x * 2]))
    other = rng.random((50, 5)) * 3
    paths = np.array([[path_by_hand(forest, row, root) for root in forest.roots] for row in other])
    assert np.allclose(forest.score(other), 2.0 ** (-paths.mean(1) / expected_path(64)))
    own = np.array([[path_by_hand(forest, row, root) for root in forest.roots] for row in x])
    want = [np.mean([p for p, u in zip(own[k], forest.unseen[:, k], strict=True) if u]) for k in range(len(x))]
    assert np.allclose(forest.score_unseen(x), 2.0 ** (-np.array(want) / expected_path(64)))
    assert [(~u).sum() for u in forest.unseen] == [64] * 20
    for n in (50, 256, 5000):  # with the harmonic number of n - 1, of which the usual formula takes the logarithm and Euler's constant
        assert float(expected_path(n)) == pytest.approx(2 * sum(1 / k for k in range(1, n)) - 2 * (n - 1) / n, rel=0.01)
    # a leaf is as deep as its path says, and holds the rows that the split put there
    for k, root in enumerate(forest.roots):
        seen = x[~forest.unseen[k]]
        depth = {root: (0, seen)}
        stack = [root]
        while stack:
            at = stack.pop()
            d, rows = depth[at]
            if forest.left[at] == at:
                assert forest.path[at] == pytest.approx(d + float(expected_path(len(rows))))
                continue
            go = rows[:, forest.column[at]] <= forest.value[at]
            for side, part in ((forest.left[at], rows[go]), (forest.right[at], rows[~go])):
                depth[side] = (d + 1, part)
                stack.append(side)


def test_verdict_and_limit(docs, spark, sf):
    labels = textcore.table(spark, sf, "labels")
    rules = op9.fit_rules(docs, labels)
    rows = [(r["doc_id"], r["text"], r["quality"]) for r in docs.join(labels, "doc_id").collect()]
    by_hand = {}
    for d, t, q in rows:
        c = counts_by_hand(t)
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        row = np.sqrt(ratios_by_hand(c))
        score = 2.0 ** (-np.mean([path_by_hand(rules.forest, row, root) for root in rules.forest.roots]) / rules.forest.norm)
        by_hand[d] = (failed, score, q, row)
    for r in op9.judge(docs.join(labels.select("doc_id"), "doc_id"), rules).collect():
        failed, score, _, _ = by_hand[r["doc_id"]]
        assert r["base_failed"] == failed and r["anomaly"] == pytest.approx(score) and r["kept"] == (not failed and r["anomaly"] <= rules.limit)
    # no other limit judges fewer labelled rows wrongly: good ones by trees that haven't seen them
    good = sorted((d for d, v in by_hand.items() if v[2] == 1 and counts_by_hand(dict((a, b) for a, b, _ in rows)[d])["n_words"] >= 20))
    x, y = op9.sample_matrix(docs, labels, "quality", ["n_words", "n_repeat_words", *stats.RATIOS])
    ok = (y == 1) & (x[:, 0] >= 20)
    unseen = rules.forest.score_unseen(np.sqrt(x[ok][:, 2:]))[~op9.base_failed(x[ok][:, 0], x[ok][:, 1])]
    bad = [v[1] for v in by_hand.values() if v[2] == 0 and not v[0]]
    wrong = lambda limit: (unseen > limit).sum() + sum(s <= limit for s in bad)
    assert len(good) == ok.sum() and wrong(rules.limit) == min(wrong(s) for s in [0.0, 1.0, *unseen, *bad])


def test_repeated_ids_and_labels_stay_within_the_limits(spark, docs, monkeypatch):
    docs_ = docs.select("doc_id", "text", "lang")
    crowd = spark.range(10_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat_ws(" ", F.lit("many rows of one id"), F.col("id") % 50).alias("text"), F.lit("en").alias("lang"))
    both = docs_.unionAll(crowd)
    labels = spark.range(10_000).select(F.lit(7).cast("bigint").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).unionAll(docs.select("doc_id", F.lit(1)))
    rows = op9.labelled_sample(both, labels, "quality", limit=100)
    assert rows.select("doc_id", "label").distinct().count() == 100 and rows.count() <= 100 + 2 * 10_001
    x, y = op9.sample_matrix(both, labels, "quality", ["n_words"], limit=100)
    assert len(y) == 100
    taken = []
    plain = op6.arrow_map
    monkeypatch.setattr(op6, "arrow_map", lambda df, fn, schema: taken.append(df.count()) or plain(df, fn, schema))
    model = op6.learn(both, per_language=30)
    assert 90 < taken[0] <= 4 * 30 and model.families is not None
    short = spark.createDataFrame([(k, "a" if k % 2 else "ü", "en" if k % 2 else "de") for k in range(3000)], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in op6.identify(short, op6.learn(short)).collect()} == {"en", "de"}
