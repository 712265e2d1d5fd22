"""From raw documents to token ids: five stages, each over all that the one before kept.

Each stage's result is written to the shared folder and read back, which cuts lineage.

Defined results: null and empty texts fail the quality rules, and so does whatever has
fewer than 20 words; without labels of both kinds only the base limits decide.  Of documents
that are alike the one with the least id stays (null is the least); of rows of equal id and
text one.  Null ids, repeated ids with other texts, and nulls in any other column pass
through.  Texts of any length are handled whole.  Columns beyond those of ``documents`` are
carried to the last stage, whatever their names; that one returns doc_id, n_tokens,
ids_sha256, decoded_sha256 and ids.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import op4_ngram_join, op5_decontamination, op8_secret_scans, op9_quality_rules, op10_bpe
from millrace.llm.store import written

STAGES = [
    ("quality_rules", op9_quality_rules.stage),
    ("ngram_join", op4_ngram_join.stage),
    ("decontamination", op5_decontamination.stage),
    ("secret_scans", op8_secret_scans.stage),
    ("bpe", op10_bpe.stage),
]

#: The forest, MinHash and BPE have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
