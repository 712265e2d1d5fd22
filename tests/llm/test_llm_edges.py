"""Texts that defeat weak hashes, partitionings, clashing names, nulls, ties and empty tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import LONG, ODD, PATH, block, brute_links, plain_counts

from millrace.llm import bpe, lexicon, op1_quality_classifier, op4_ngram_join, op5_decontamination, op6_language_id, op7_token_output, op8_secret_scans, op9_quality_rules, op10_bpe, wavelet
from millrace.llm.store import scratch_path


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[bin(k).count("1") & 1] for k in range(n))


#: Pairs that collide under any polynomial hash modulo a power of two.
TWINS = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (64, 1024, 2048, 4096)]


# -- hashes ------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["library", "own", "lexicon"])
def test_token_ids_of_thue_morse_words(kind):
    enc = op7_token_output.LibraryEncoder(PATH) if kind == "library" else bpe.BytePairEncoder(PATH)
    tok = op7_token_output.LibraryEncoder(PATH).tok
    if kind == "lexicon":
        enc.lexicon = lexicon.Lexicon(op10_bpe.compile_lexicon([b" ab", b" ba", *(f" {t[:30]}".encode() for p in TWINS for t in p)], PATH))
    texts = [f"x {t} y {t}" for pair in TWINS for t in pair] + [t for pair in TWINS for t in pair]
    ids, bounds = enc.encode(block(texts))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_thue_morse_words_and_lines_are_told_apart():
    words = [w for pair in TWINS for w in pair]
    blk = block([" ".join(words)])
    assert len({*blk.word_hashes().tolist()}) == len(words)
    texts = []
    for a, b in TWINS:
        texts += [f"{a}\n{b}\n{a}\n{b} c", " ".join([a, b, "c", "d", "e", "f", "g", "h", b, a, "c", "d", "e", "f", "g", "h"])]
        texts.append(" ".join([a, "c", "d", "e", "f", "g", "h", "i", b, "c", "d", "e", "f", "g", "h", "i"]))
    c = op9_quality_rules.block_counts(block(texts))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(c[n][k]) for n in names) for k in range(len(texts))] == [plain_counts(t) for t in texts]


def test_thue_morse_words_in_joins(spark):
    filler = [f"w{k}" for k in range(30)]
    texts = [" ".join([*filler[:k], w, *filler[k:]]) for a, b in TWINS for k, w in ((3, a), (3, b))]
    texts += [" ".join([w] * 3 + filler[:4]) for a, b in TWINS for w in (a, b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    documents, nodes = op4_ngram_join.near_duplicates(df)
    got = {r["id"]: (r["links"], r["class_id"]) for r in documents.join(nodes, "node").collect()}
    n, root = brute_links(texts)
    assert [got[k] for k in range(len(texts))] == list(zip(n, root, strict=True))
    items = [f"{a} {b} {a}" for a, b in TWINS] + [f"{b} {a} {b}" for a, b in TWINS]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = spark.createDataFrame([(k, f"so {t} it goes on and on") for k, t in enumerate(items)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in op5_decontamination.contained(docs, bench).collect()} == {(k, k) for k in range(len(items))}


# -- 5: several blocks of items ---------------------------------------------------------------


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(op5_decontamination, "ITEM_BYTES", 400)
    rng = np.random.default_rng(6)
    items = [" ".join(f"q{rng.integers(10**6)}" for _ in range(12)) for _ in range(20)]
    df = spark.createDataFrame([(k, f"a b c {t} d") for k, t in enumerate(items)] + [(99, "nothing of the kind here")], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in op5_decontamination.contained(df, bench).collect()} == {(k, k) for k in range(20)}
    monkeypatch.setattr(op5_decontamination, "table", lambda *_: bench)
    assert [r["doc_id"] for r in op5_decontamination.stage(spark, df, "").collect()] == [99]


# -- 6: partitions, plain Python -----------------------------------------------------------------


def plain_trigrams(text: str) -> list[bytes]:
    d = b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()) + b" "
    return [d[i - 1 : i + 2] for i in range(1, len(d) - 1) if d[i] != 32]


def test_language_scores_by_brute_force_and_under_any_partitioning(spark, docs):
    model = op6_language_id.learn(docs)
    short = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(["I", "ab", "a", "é", None, "", "...", "x" * 70000, LONG])], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").unionByName(short)
    got = [{r["doc_id"]: (r["lang_pred"], r["score"]) for r in op6_language_id.identify(rows.repartition(n, F.xxhash64("doc_id", F.lit(n))), model).collect()} for n in (1, 3, 50)]
    assert got[0] == got[1] == got[2] and len(got[0]) == rows.count()
    for r in rows.where("doc_id < 40 or doc_id >= 1000000").collect():
        t = r["text"] or ""
        if not any(c.isalpha() for c in t):
            assert got[0][r["doc_id"]] == ("und", 0.0)
            continue
        slots = [(int.from_bytes(g, "big") * 2654435761 & 0xFFFFFFFF) >> (32 - op6_language_id.BITS) for g in plain_trigrams(t)]
        margins = [sum(int(w[s]) for s in slots) * model.unit / len(slots) + b for w, b in zip(model.weights, model.bias, strict=True)]

        def winner(duels, margins=margins):
            votes = {n: [0, 0.0] for n in duels.names}
            for a, b, k in duels.pairs:
                votes[duels.names[a if margins[k] > 0 else b]][0] += 1
                votes[duels.names[a]][1] += np.tanh(margins[k])
                votes[duels.names[b]][1] -= np.tanh(margins[k])
            return max(duels.names, key=lambda n: votes[n][0] + 1e-3 * votes[n][1])

        family = winner(model.families)
        assert got[0][r["doc_id"]][0] == winner(model.within[model.families.names.index(family)])


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(op6_language_id, "MAX_LANGUAGES", 3)
    rows = spark.createDataFrame([(k, "text", f"l{k}") for k in range(4)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="4 languages"):
        op6_language_id.learn(rows)


# -- 7: select ------------------------------------------------------------------------------------


def test_wavelet_select_against_a_scan():
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.integers(0, 5, 3000), np.full(2000, 3), rng.integers(0, 50257, 3000)])
    w = wavelet.WaveletMatrix(wavelet.encode(x, 16, [], np.zeros(0)))
    for v in (0, 3, 4, int(x[-1])):
        at = np.flatnonzero(x == v)
        assert w.occurrences(v).tolist() == at.tolist()
        assert w.select(v, len(at) // 2).tolist() == [at[len(at) // 2]]


# -- 8: history ---------------------------------------------------------------------------------


def test_second_version_scans_new_blobs_and_rules_only(spark, monkeypatch):
    ledger = scratch_path(spark, "ledger")
    schema = "doc_id bigint, text string"
    first = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "none"), (3, "token=abcdefgh1"), (None, "none")], schema)
    second = spark.createDataFrame([(1, "token=abcdefgh2"), (2, "none"), (3, "token=abcdefgh1")], schema)
    n_rules = len(op8_secret_scans.RULES)
    op8_secret_scans.update_ledger(first, ledger, version="a")
    assert op8_secret_scans.read_ledger(spark, ledger).count() == 2 * n_rules
    op8_secret_scans.update_ledger(second, ledger, version="b")
    assert op8_secret_scans.read_ledger(spark, ledger).count() == 3 * n_rules
    spans = lambda v: sorted((r["path"] or 0, r["version"], [(f["start"], f["end"]) for f in r["findings"] or []]) for r in op8_secret_scans.findings_by_path(spark, ledger, v).collect())
    hit = [(0, 15)]
    assert spans("a") == [(0, "a", []), (1, "a", hit), (2, "a", []), (3, "a", hit)]
    assert spans("b") == [(1, "b", hit), (2, "b", []), (3, "b", hit)] and len(spans(None)) == 7
    monkeypatch.setitem(op8_secret_scans.RULES, "hex", (2, *op8_secret_scans.RULES["hex"][1:]))  # a rule changes: its pairs are new
    op8_secret_scans.update_ledger(second, ledger, version="c")
    rules = op8_secret_scans.read_ledger(spark, ledger).groupBy("rule").count().collect()
    assert {r["rule"]: r["count"] for r in rules if r["rule"].startswith("hex")} == {"hex@1": 3, "hex@2": 3}


# -- stages on clashing names, ties, repeats, empty tables ---------------------------------------------

CLASHING = ["_key", "_node", "_rep", "_row", "key", "node", "row", "own", "id", "rep", "__blob", "__findings", "blob", "findings", "found", "b", "lead", "n", "stays", "times"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en", "s", len(t) if t is not None else None, *(f"{c}{i}" for c in CLASHING)) for i, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (*rows[4][:5], *("other" for _ in CLASHING)), (None, None, None, None, None, *(None for _ in CLASHING))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


STAGES = [op9_quality_rules.stage, op4_ngram_join.stage, op5_decontamination.stage, op8_secret_scans.stage]


@pytest.mark.parametrize("stage", STAGES, ids=["rules", "join", "leaks", "secrets"])
def test_stages_carry_clashing_columns(spark, sf, clashing, stage):
    out = stage(spark, clashing, sf)
    assert out.dtypes == clashing.dtypes
    before = {tuple(r) for r in clashing.drop("text", "n_chars").collect()}
    got = out.collect()
    assert {tuple(r[c] for c in out.columns if c not in ("text", "n_chars")) for r in got} <= before
    if stage is op4_ngram_join.stage:
        again = op4_ngram_join.stage(spark, clashing.repartition(2), sf).collect()
        key = lambda rows: sorted(repr(r) for r in rows)
        assert key(got) == key(again)
        _, root = brute_links(ODD)
        assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted({*root} - {0})
        assert sum(r["doc_id"] is None for r in got) == 1  # null text is the empty text, and null the least id
    assert stage(spark, clashing.limit(0), sf).count() == 0


def test_last_stage_and_scores_on_clashing_and_empty_tables(spark, clashing):
    got = op10_bpe.stage(spark, clashing, "").collect()
    assert len(got) == clashing.count()
    assert op10_bpe.stage(spark, clashing.limit(0), "").count() == 0
    model = op1_quality_classifier.fit(clashing.limit(0), spark.createDataFrame([], "doc_id bigint, quality int"))
    assert op1_quality_classifier.score(clashing.limit(0), model).count() == 0
    assert op1_quality_classifier.score(clashing.select("doc_id", "text"), model, keep_text=False).count() == clashing.count()


def test_pipeline_on_odd_rows(spark, clashing, tmp_path):
    import corpus_pipeline

    good = spark.createDataFrame([(1000 + k, " ".join(f"word{(k * 31 + j * j) % 997}" for j in range(60)) + (" password = hunter2hunter2" if k == 5 else "")) for k in range(12)], "doc_id bigint, text string")
    whole = clashing.unionByName(good, allowMissingColumns=True)
    for name, df in (("documents", whole), ("labels", spark.createDataFrame([], "doc_id bigint, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string"))):
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert {1000 + k for k in range(12)} <= got.keys()
    tok = op7_token_output.LibraryEncoder(PATH).tok
    assert "[SECRET]" in tok.decode(got[1005]["ids"])


def test_quality_counts_of_repeated_labelled_ids(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c d"), (2, "x y")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1)], "doc_id bigint, quality int")
    x, y = op9_quality_rules.sample_matrix(rows, labels, "quality", ["n_words"])
    assert sorted(zip(x[:, 0].tolist(), y.tolist(), strict=True)) == [(2.0, 0), (3.0, 0), (3.0, 1)]


def test_words_of_nuls_and_controls_enter_the_lexicon(spark):
    """Whatever a frequent word ends in, its ids are the library's."""
    odd = ["\x00 x", "\x00", "\x00\x00\x00", " ", "  ", "\t\x00 ", "a\x00", "\x00a\x00", "\x01\x02\x00 b\x00\x00", "\x7f \x00\n\x00", "ordinary words", "é\x00 é"]
    rows = [(k, t) for k, t in enumerate(odd * 12)] + [(10**6, " ".join(odd) * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = op10_bpe.frequent_words(df, PATH)
    assert any(w.endswith(b"\x00") for w in words) and b"" not in words
    tok = op7_token_output.LibraryEncoder(PATH).tok
    got = {r["doc_id"]: r["ids"] for r in op10_bpe.encode(df, PATH).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        assert got[k] == tok.encode(t, add_special_tokens=False).ids, repr(t)
