"""Secret scans: an incremental ledger of blobs.

Every version of a text is a blob, addressed by its SHA-256.  The ledger is a folder of
two tables.  ``findings`` has a row for each blob and rule version that was ever scanned;
``versions`` has a row for each path (document id), version and blob that was ever seen.
A run records its documents as a version, scans only the pairs of blob and rule version
that the ledger lacks, once for each blob however many paths have it, and joins the
findings back to all paths (``findings_by_path``: of any version, or of all of history).

Rules: the base kinds ``assign``, ``access`` and ``hex``, and beyond them ``pem``
(private key headers) and ``jwt`` (signed tokens).  Letter case is ASCII case.
Spans are code points, end exclusive, of the whole match.

Defined results: null text is the empty text; repeated rows and ids each get their
row; a text without secrets has counts of 0, an empty ``spans`` and the hash of the
empty string.  Texts of any length are scanned whole.  An empty table gives no rows.
Null ids are paths like others.  ``stage`` carries all columns in a struct, so no name of
the input can clash with those used here.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .store import scratch_path, written
from .textcore import Block, arrow_map, blocks, table

# The kinds in order, each with its version, pattern, group and least length.
RULES = {
    "assign": (1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (1, r"[0-9a-f]+", 0, 32),
    "pem": (1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
}
BASE = ["assign", "access", "hex"]
HINTS = {"assign": [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"], "access": [b"AKIA"], "pem": [b"-----BEGIN "], "jwt": [b"eyJ"]}
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
#: A findings table up to this size is sent to all executors; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20
MASK = "[SECRET]"


def rule_key(kind: str, rules: dict | None = None) -> str:
    return f"{kind}@{(rules or RULES)[kind][0]}"


def scan_text(kind: str, text: str, rules: dict | None = None) -> list[tuple[int, int]]:
    _, pattern, group, least = (rules or RULES)[kind]
    found = re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if kind == "assign" else 0))
    return [m.span() for m in found if m.end(group) - m.start(group) >= least]


def suspects(kind: str, blk: Block) -> np.ndarray:
    """Documents of a block in which a rule can match."""
    if kind == "hex":
        edge = np.flatnonzero(np.diff(_HEX[blk.data].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        at = edge[0::2][edge[1::2] - edge[0::2] >= RULES["hex"][3]]
    else:
        raw = blk.data.tobytes()
        raw = raw.lower() if kind == "assign" else raw
        at = []
        for hint in HINTS[kind]:
            p = raw.find(hint)
            while p >= 0:
                at.append(p)
                p = raw.find(hint, p + 1)
    return np.unique(np.searchsorted(blk.doc_start, np.asarray(at, np.int64), "right") - 1)


def _scan(batches, rules: dict | None = None):
    """blob, text, todo -> blob, rule, starts, ends for each pair of blob and missing rule."""
    rules = rules or RULES
    for b, blk in blocks(batches):
        text, todo, blob = b.column("text"), b.column("todo").to_pylist(), b.column("blob")
        rows, rule, starts, ends = [], [], [], []
        for kind in rules:
            key = rule_key(kind, rules)
            hot = {*suspects(kind, blk).tolist()}
            for d, wanted in enumerate(todo):
                if key in wanted:
                    found = scan_text(kind, text[d].as_py(), rules) if d in hot else []
                    rows.append(d)
                    rule.append(key)
                    starts.append([s for s, _ in found])
                    ends.append([e for _, e in found])
        yield pa.RecordBatch.from_arrays([blob.take(pa.array(rows, pa.int64())), pa.array(rule, pa.string()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["blob", "rule", "starts", "ends"])


LEDGER = "blob binary, rule string, starts array<bigint>, ends array<bigint>"
FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"


def blob_of(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All scanned pairs of blob and rule version."""
    path = f"{ledger}/findings"
    return spark.read.schema(LEDGER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LEDGER)


def _keys(keys: DataFrame, n: int) -> DataFrame:
    """Keys of blobs, marked for broadcast if n of them are small enough."""
    return F.broadcast(keys) if n * 128 <= BROADCAST_BYTES else keys


def unscanned(rows: DataFrame, versions: DataFrame, seen: DataFrame, known: list[str]) -> DataFrame:
    """blob, text, todo of one row for each blob that lacks a rule version; ``rows`` have blob, id, text, ``versions`` blob and id.

    Texts are not shuffled where a broadcast can tell which rows to read: those with
    something to do if they are few, or else those with nothing to do if these are.
    """
    wanted = F.array(*[F.lit(k) for k in known])
    done = seen.where(F.col("rule").isin(known)).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    leads = versions.groupBy("blob").agg(F.min("id").alias("lead")).join(done, "blob", "left")
    leads = written(leads.select("blob", "lead", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))).alias("todo")), "leads")
    n = leads.agg(F.count("*").alias("all"), F.count_if(F.size("todo") > 0).alias("open"), F.count_if(F.size("todo") == len(known)).alias("new")).first()
    todo = leads.where(F.size("todo") > 0).select(F.col("blob").alias("b"), "lead", "todo")
    same = F.expr("blob = b and id <=> lead")
    if n["open"] == n["new"]:  # nothing was scanned by some of the rules only
        idle = written(versions.join(todo, same, "left_anti").select(F.col("blob").alias("b"), F.col("id").alias("lead")).distinct(), "idle")
        n_idle = idle.count()
        if n_idle < n["open"] and n_idle * 128 <= BROADCAST_BYTES:
            return rows.join(F.broadcast(idle), same, "left_anti").select("blob", "text", wanted.alias("todo"))
    return rows.join(_keys(todo, n["open"]), same).select("blob", "text", "todo")


def update_ledger(docs: DataFrame, ledger: str, id_col: str = "doc_id", text: str = "text", version: str | None = None) -> DataFrame:
    """Records the documents as a version (a new name if none is given) and scans what the ledger lacks; returns blob, findings (kind, start, end) of all blobs with any."""
    spark, version = docs.sparkSession, version or uuid.uuid4().hex
    rows = docs.select(blob_of(text).alias("blob"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows.select(F.col("id").alias("path"), F.lit(version).alias("version"), "blob").write.mode("append").parquet(f"{ledger}/versions")
    versions = read_versions(spark, ledger, version).select("blob", F.col("path").alias("id"))
    known = [rule_key(k) for k in RULES]
    fresh = unscanned(rows, versions, read_ledger(spark, ledger), known)
    rules = dict(RULES)  # workers scan by the rules that the driver has now

    def scan(batches):
        yield from _scan(batches, rules)

    arrow_map(fresh, scan, LEDGER).dropDuplicates(["blob", "rule"]).write.mode("append").parquet(f"{ledger}/findings")
    return findings(spark, ledger)


def read_versions(spark: SparkSession, ledger: str, version: str | None = None) -> DataFrame:
    """path, version, blob of one version or of all."""
    every = spark.read.parquet(f"{ledger}/versions")
    return every if version is None else every.where(F.col("version") == version)


def findings(spark: SparkSession, ledger: str) -> DataFrame:
    """blob, findings (kind, start, end) of all blobs in which the present rules have found something."""
    known = [rule_key(k) for k in RULES]
    found = read_ledger(spark, ledger).where(F.col("rule").isin(known) & (F.size("starts") > 0)).dropDuplicates(["blob", "rule"])
    one = found.select("blob", F.substring_index("rule", "@", 1).alias("kind"), F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    return one.groupBy("blob").agg(F.collect_list(F.struct("kind", F.col("s.starts").alias("start"), F.col("s.ends").alias("end"))).alias("findings"))


def findings_by_path(spark: SparkSession, ledger: str, version: str | None = None) -> DataFrame:
    """path, version, blob, findings of all paths that a version (or any in history) has; findings are null where there are none."""
    return with_findings(read_versions(spark, ledger, version), findings(spark, ledger))


def ordered(findings: str, kinds: list[str]) -> Column:
    """Findings of these kinds as kind:start:end, by start, then kind as listed, comma-joined."""
    rank = F.create_map(*[x for k, n in enumerate(kinds) for x in (F.lit(n), F.lit(k))])
    own = F.filter(F.coalesce(F.col(findings), F.array().cast(FOUND)), lambda x: x["kind"].isin(kinds))
    by = F.array_sort(F.transform(own, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(by, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def with_findings(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds findings by blob: by broadcast behind a check of the size, else by shuffle."""
    found = written(found, "findings")
    size = found.agg(F.count("*"), F.sum(F.size("findings"))).first()
    small = size[0] * 64 + (size[1] or 0) * 48 <= BROADCAST_BYTES
    found = found.select(F.col("blob").alias("found"), "findings")
    return rows.join(F.broadcast(found) if small else found, F.col("blob") == F.col("found"), "left").drop("found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = scratch_path(spark, "ledger")
    update_ledger(table(spark, sf_dir, "documents"), ledger, version="1")
    rows = findings_by_path(spark, ledger, "1")
    count = lambda k: F.coalesce(F.size(F.filter("findings", lambda x: x["kind"] == k)), F.lit(0)).cast("bigint").alias(f"n_{k}")
    return rows.select(F.col("path").alias("doc_id"), *(count(k) for k in BASE), F.sha2(ordered("findings", BASE), 256).alias("base_sha256"), ordered("findings", list(RULES)).alias("spans"))


def masked(text: str, findings: list[dict]) -> str:
    """The text with every found span, overlapping ones as one, replaced by MASK."""
    out, at = [], 0
    spans: list[list[int]] = []
    for s, e in sorted((f["start"], f["end"]) for f in findings):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    for s, e in spans:
        out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars made to agree."""
    found = update_ledger(docs, scratch_path(spark, "ledger"))
    names = docs.columns
    rows = with_findings(docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), blob_of("text").alias("blob")), found)
    own = {n: F.col("row").getField(n) for n in names}

    def mask(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([masked(t, h) for t, h in zip(b.column("text").to_pylist(), b.column("findings").to_pylist(), strict=True)], pa.string())], names=["row", "text"])

    # texts without findings, nearly all, stay in the JVM
    clean = rows.where(F.col("findings").isNull()).select(*[own[n].alias(n) for n in names])
    row_type = rows.schema["row"].dataType
    hit = rows.where(F.col("findings").isNotNull()).select("row", own["text"].alias("text"), "findings")
    hit = arrow_map(hit, mask, StructType([StructField("row", row_type), StructField("text", StringType())]))
    new = own | {"text": F.col("text")} | ({"n_chars": F.length("text").cast(row_type["n_chars"].dataType)} if "n_chars" in names else {})
    return clean.unionAll(hit.select(*[new[n].alias(n) for n in names]))
