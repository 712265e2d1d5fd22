"""The registered queries: columns of their contracts, whole tables, and SQL where there is some."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import oracle
import pytest

from millrace.llm import op10_bpe, queries
from millrace.llm.op7_token_output import LibraryEncoder
from millrace.llm.textcore import bounded_sample, table

QUERIES, SQL = queries.queries(), queries.oracle_sql()
COLUMNS = {
    "op1_quality_classifier": "doc_id held_out score predicted",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4_ngram_join": "doc_id class_id n_links",
    "op5_decontamination": "doc_id item_id containment",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_token_output": "doc_id start n_tokens ids_crc32",
    "op8_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_fill_in_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op12_source_divergence": "lang source part item value rank",
    "op13_simhash": "doc_id fingerprint component_id",
}


def test_all_are_there():
    assert sorted(COLUMNS) == sorted(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, sf, name):
    assert oracle.difference(QUERIES[name](spark, sf), oracle.connect(sf), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS.keys() - {"op3_chat_format", "op5_decontamination", "op12_source_divergence"}))
def test_a_row_for_each_document(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert {*COLUMNS[name].split()} <= {*df.columns}
    ids = sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in table(spark, sf, "documents").select("doc_id").collect())
    if "held_out" in df.columns:
        modulus, rest = {"op1": (3, 1), "op2": (5, 0), "op6": (5, 0)}[name[:3]]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in df.collect())


def test_tokens_of_the_table(spark, sf):
    tok = LibraryEncoder(op10_bpe.tokenizer_path()).tok
    text = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    start = 0
    for r in sorted(QUERIES["op7_token_output"](spark, sf).collect()):
        ids = [*tok.encode(text[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for r in QUERIES["op10_bpe"](spark, sf).collect():
        ids = tok.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bounded_sample_is_the_smallest_hashes(spark):
    df = spark.range(5000)
    a = {r["id"] for r in bounded_sample(df, 100, "id").collect()}
    b = {r["id"] for r in bounded_sample(df.repartition(7), 100, "id").collect()}
    assert len(a) == 100 and a == b and bounded_sample(df, 9000, "id").count() == 5000
