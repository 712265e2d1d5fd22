"""Divergences against sums over all kept terms, with whole numbers of any size."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import op12_source_divergence as op

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    """All results of rows (text, lang, source), term by term."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
        count[lang, source].update(words)
        docs[lang].update({*words})
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= min_docs) for lang, _ in groups}

    def shares(c, terms):
        size = sum(c[t] for t in terms) + 5 * len(terms)
        return {t: 1 + 10**9 * (c[t] + 5) // size for t in terms}

    p = {g: shares(count[g], kept[g[0]]) for g in groups}
    whole = {lang: sum((count[g] for g in groups if g[0] == lang), Counter()) for lang, _ in groups}
    q = {lang: shares(whole[lang], kept[lang]) for lang in kept}
    out = []
    for lang, source in groups:
        terms = kept[lang]
        a = [(sum(abs(p[lang, source][t] - p[lang, s][t]) for t in terms), s) for x, s in groups if x == lang and s != source]
        b = [(p[lang, source][t] - q[lang][t], t) for t in terms if count[lang, source][t] and p[lang, source][t] > q[lang][t]]
        for part, found, most in (("pair", a, len(a)), ("term", b, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def run(spark, rows, min_docs, top=5):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("value", F.lit("clash"))
    return sorted(tuple(r) for r in op.audit(df.repartition(5), min_docs, top).select("lang", "source", "part", "item", "value", "rank").collect())


def test_same_as_sums_over_all_terms(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("Ab", "é", "zé", "x") for b in "abcdefghij"]
    rows = []
    for k in range(400):
        source = f"s{min(k % 13, 7)}"  # one source has half of the rows
        own = words[: 10 + 4 * (k % 7)] if k % 3 else words
        n = int(rng.integers(0, 60)) if source != "s1" else 3
        rows.append((" 1-".join(rng.choice(own, n)), ["en", "de", None][k % 3], None if source == "s2" else source))
    rows += [("", "en", "empty"), (None, "en", "null"), ("123 -- [\\]", "en", "symbols"), ("only", "one", "alone"), (None, "two", "a"), ("b", "two", "b")]
    rows += rows[:20]
    for min_docs in (1, 10, 60):
        assert run(spark, rows, min_docs) == brute(rows, min_docs, 5)


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 5), (5, 5), (3 * 10**12 + 7, 9 * 10**12 + 1), (10**15, 3 * 10**15 - 1), (9 * 10**15 - 1, 9 * 10**15)]
    df = spark.createDataFrame(cases, "c bigint, t bigint").select("c", "t", op.share(F.col("c"), F.col("t")).alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * c // t for c, t in cases]
    assert spark.range(1).select(op.share(F.lit(5), F.col("id")).alias("p")).first()["p"] is None


def test_empty_table_and_long_text(spark):
    assert run(spark, [], 1) == []
    rows = [("wort Wort WORT " * 200_000, "de", "a"), ("wort anderes", "de", "b"), ("ﬀ" * 100_000, "de", "c")]
    assert run(spark, rows, 1) == brute(rows, 1, 5)
