"""Cuts and their reverse: any text, both kinds of units, and rows of odd make."""

from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import op11_fill_in_middle as fim

TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab1 \n<>PSM\x00é𝄞"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(-5, 10**12), st.sampled_from(["codepoint", "run"]))
def test_any_text_comes_back(text, doc_id, unit):
    raw = text.encode()
    n, form, prefix, middle, output = fim.cut(raw, doc_id, unit)
    assert fim.restore(output, form) == raw
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    assert list(fim.draws(doc_id)) == h
    if form == "plain":
        assert output == raw and prefix is middle is None and (not text or h[2] % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")))
        return
    assert form == ("spm" if h[3] % 100 < 20 else "psm") and h[2] % 100 < 90
    if unit == "codepoint":
        a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
        p, m, s = text[:a], text[a:b], text[b:]
        assert (n, prefix, middle) == (len(text), a, b - a)
        assert output.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_units_are_runs_of_a_class():
    points = fim.codepoints("ab12  é-!\n".encode())
    assert fim.bounds_of(points, "run").tolist() == [0, 2, 4, 6, 7, 9, 10]
    assert fim.bounds_of(points, "codepoint").tolist() == list(range(11))
    assert fim.bounds_of(points[:0], "run").tolist() == [0] and fim.bounds_of(points[:1], "codepoint").tolist() == [0, 1]


def test_bytes_that_are_no_text_come_back():
    for raw in (b"ab\xff\xfecd", b"\xed\xa0\x80x" * 9, b"\xc3"):
        for doc_id in range(20):
            _, form, _, _, output = fim.cut(raw, doc_id)
            assert fim.restore(output, form) == raw


def test_odd_rows(spark):
    long = "wörter und mehr " * 100_000
    rows = [(1, None, "a"), (2, "", "b"), (None, "no id", "c"), (3, long, None), (3, long, None), (4, "has <M> inside", "e"), (5, "x", "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra string").withColumn("form", F.lit("clash"))
    got = fim.transform(df, keep=("extra",))
    assert got.columns == ["doc_id", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted((r["doc_id"] or 0, r["n"]) for r in got.collect()) == [(0, 5), (1, 0), (2, 0), (3, len(long)), (3, len(long)), (4, 14), (5, 1)]
    back = sorted((r["doc_id"] or 0, r["text"]) for r in fim.restored(got).collect())
    assert back == sorted((i or 0, t or "") for i, t, _ in rows)
    assert fim.transform(df.limit(0)).count() == 0
    try:
        fim.transform(df, keep=("form",))
        raise AssertionError("a clash must be refused")
    except ValueError as e:
        assert "form" in str(e)
