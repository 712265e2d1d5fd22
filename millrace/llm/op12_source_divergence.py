"""Source divergence audit: smoothed term shares of sources against each other and their language.

A language keeps the terms of at least ``MIN_DOCS`` of its documents (V of them).  In a source
of the language, a kept term that occurs c times has the share ``1 + floor(10^9 (c + 5) / (N + 5 V))``,
N the source's occurrences of kept terms; the divergence of two sources is the sum of the
absolute differences of all V shares.

Baseline-correction inverted index: of the V terms of a pair most have a count of zero in one
source or both, and there the share is a constant z of the source.  So a pair starts at
V |z_a - z_b|, as if every count were zero, and is corrected where one isn't:

- a term that only a has puts |p_a - z_b| in the place of |z_a - z_b|.  That depends on b by z_b
  alone, so it is summed from the histogram of a's shares: sum of p_a - z_b, and twice
  z_b - p_a for the few shares below z_b;
- a term that both have gets what is left of |p_a - p_b| then; the postings of a term meet
  each other for that, each pair once, and pre-aggregated sums are all that is shuffled.

So nothing is done for terms that neither has, and one histogram row for terms that one has.
All arithmetic is on whole numbers; a share is found by long division in base 1000, exact up to
9 * 10^15 occurrences.  The terms of highest excess over the language come from a window of
ranks, which Spark cuts to ``TOP`` rows of each source before it shuffles.

Words are counted in Arrow workers by block, and added up by Spark by (lang, source, term),
whose number is bounded by the vocabulary and not by the texts.

Defined results: null text, lang and source count as ''.  Sources without any term take part
(each with shares of zero counts).  A language without kept terms has values of 0 and no rows
of part ``term``.  A source alone in its language has no rows of part ``pair``.  Ties are ranked
by item in UTF-8 order.  Rows that occur twice count twice; ids are not used.  Texts of any
length are read whole, and other columns of any names not at all.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import drop, written
from .textcore import Block, arrow_map, blocks, mix, table

#: Documents of a language that a kept term is in, at least; terms listed for a source, at most.
MIN_DOCS, TOP = 30, 50
#: Added to every count, and the sum that shares are scaled to.
EXTRA, SCALE = 5, 10**9
#: Bytes of text whose words are counted at once.
COUNT_BYTES = 2 << 20

#: What a byte becomes: a term's byte with A-Z lower-cased, or a blank between terms.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _groups(b: pa.RecordBatch) -> tuple[np.ndarray, list[str], list[str]]:
    """The group of each row, and language and source of each group."""
    pairs = [*zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)]
    number: dict[tuple[str, str], int] = {}
    of = np.array([number.setdefault(p, len(number)) for p in pairs], np.int64)
    return of, [p[0] for p in number], [p[1] for p in number]


def _counted(batches):
    """lang, source, term (null: the group is there), occurrences and rows that have it, by block."""
    for b, blk in blocks(batches, limit=COUNT_BYTES):
        of, langs, sources = _groups(b)
        blk = blk.with_data(_FOLD[blk.data])
        s, e, first = blk.words()
        doc = np.repeat(np.arange(blk.n), np.diff(first))
        h = blk.hash_spans(s, e)
        # one number for each (group, term), and one for each (row, term)
        key = mix(h ^ mix(of[doc].astype(np.uint64) + np.uint64(1)))
        in_doc = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1 << 32)))
        key, at, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        once = np.unique(in_doc, return_index=True)[1]
        rows = np.bincount(back[once], minlength=len(key))
        terms = _spans(blk, s[at], e[at])
        group = of[doc[at]]
        blank = len(langs)  # a row for each group, whether it has terms or not
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()).take(pa.array(np.append(group, np.arange(blank)))),
                pa.array(sources, pa.string()).take(pa.array(np.append(group, np.arange(blank)))),
                pa.concat_arrays([terms, pa.nulls(blank, pa.binary())]).cast(pa.string()),
                pa.array(np.append(n, np.zeros(blank, np.int64))),
                pa.array(np.append(rows, np.zeros(blank, np.int64))),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def _spans(blk: Block, s: np.ndarray, e: np.ndarray) -> pa.Array:
    raw = blk.data.tobytes()
    return pa.array([raw[a:z] for a, z in zip(s, e, strict=True)], pa.binary())


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, docs: what each group has; a row without a term for each group."""
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]
    found = arrow_map(docs.select(*named, F.col(f"`{text}`").alias("text")), _counted, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total) for count <= total, three digits of the quotient at a time; null if total is 0."""
    total = F.nullif(total, F.lit(0))
    quotient, rest = F.lit(0).cast("bigint"), count.cast("bigint")
    for _ in range(3):
        quotient, rest = quotient * 1000 + F.call_function("div", rest * 1000, total), rest * 1000 % total
    return quotient + 1


def shares(counted: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, postings), both written.

    groups: lang, source, v (kept terms), z (share of a count of zero; 0 if v is 0).
    postings: lang, source, term, p (the source's share) and q (the language's), where the source has the term.
    """
    terms = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"))
    kept = written(terms.where(F.col("docs") >= min_docs).select("lang", "term", "all_n"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    own = written(counted.where("n > 0").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "postings")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["v", "total", "all_total"]).withColumn("size", F.col("total") + EXTRA * F.col("v"))
    groups = written(groups.withColumn("z", F.coalesce(share(F.lit(EXTRA), F.col("size")), F.lit(0))), "groups")
    sized = own.join(groups.select("lang", "source", "size", (F.col("all_total") + EXTRA * F.col("v")).alias("all_size")), ["lang", "source"])
    p, q = share(F.col("n") + EXTRA, F.col("size")), share(F.col("all_n") + EXTRA, F.col("all_size"))
    postings = written(sized.select("lang", "source", "term", p.alias("p"), q.alias("q")), "shares")
    for t in (kept, own):
        drop(t)
    return groups, postings


def pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item, value: divergence of each source from each other one of its language."""
    own = postings.join(groups.select("lang", "source", "z"), ["lang", "source"]).select("lang", "term", "source", "p", "z")
    own = written(own, "zeros")  # both sides of the join below are dealt out anew
    a, b = (own.select("lang", "term", *(F.col(c).alias(f"{c}_{k}") for c in ("source", "p", "z"))) for k in "ab")
    far = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = a.join(b, ["lang", "term"]).where("source_a < source_b")
    both = both.groupBy("lang", "source_a", "source_b").agg(F.sum(far("p_a", "p_b") - far("p_a", "z_b") - far("z_a", "p_b") + far("z_a", "z_b")).alias("fix"))
    both = both.select("lang", "fix", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("x"))
    both = both.select("lang", "x.source", "x.item", "fix")

    # what the terms of a source say against a share of zero counts: from the histogram of its shares
    histogram = written(postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n")), "histogram")
    whole = histogram.groupBy("lang", "source").agg(F.sum("n").alias("terms"), F.sum(F.col("n") * F.col("p")).alias("sum_p"))
    whole = written(groups.join(whole, ["lang", "source"], "left").na.fill(0, ["terms", "sum_p"]).select("lang", "source", "v", "z", "terms", "sum_p"), "whole")
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("z_item"))
    below = histogram.join(other, "lang").where("p < z_item and source <> item").groupBy("lang", "source", "item").agg(F.sum((F.col("z_item") - F.col("p")) * F.col("n") * 2).alias("low"))

    theirs = whole.select("lang", F.col("source").alias("item"), F.col("z").alias("z_item"), F.col("terms").alias("terms_item"), F.col("sum_p").alias("sum_item"))
    out = whole.join(theirs, "lang").where("source <> item")
    out = out.join(both, ["lang", "source", "item"], "left").join(below, ["lang", "source", "item"], "left")
    out = out.join(below.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("low").alias("low_item")), ["lang", "source", "item"], "left").na.fill(0, ["fix", "low", "low_item"])
    base = (F.col("v") - F.col("terms") - F.col("terms_item")) * far("z", "z_item")
    alone = F.col("sum_p") - F.col("terms") * F.col("z_item") + F.col("low") + F.col("sum_item") - F.col("terms_item") * F.col("z") + F.col("low_item")
    return out.select("lang", "source", "item", (base + alone + F.col("fix")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counted = written(counts(docs, text, lang, source), "counts")
    groups, postings = shares(counted, min_docs)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    order = ["lang", "source", "part", "item", "value", "rank"]
    by_pair = written(pairs(groups, postings), "pairs").withColumn("part", F.lit("pair")).withColumn("rank", rank)
    over = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_term = over.withColumn("rank", rank).where(F.col("rank") <= top)
    return by_pair.select(order).unionAll(by_term.select(order))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
