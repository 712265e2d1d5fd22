"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Each distinct text (by MD5) is one node.  Its signature of 128 minima is cut into
``TREES`` labels of ``DEPTH`` minima, a path in a prefix trie for each tree.  Two
texts meet in a tree if their paths agree down to some depth.  How far matched
prefixes may have to be shortened follows from the wanted recall (``floor_depth``),
and the subtree at that depth is what a worker gets.  It sorts the paths, which is the
trie, and starts with the longest common prefixes: texts below one trie node whose
signatures agree well enough (all but one in a million pairs of the similarity do) are
tied together, then the prefix is shortened by one and only texts that are not tied
yet are compared, and so on down to the floor, or until the subtree is one group.

Groups only say which texts may be similar.  Within a group every pair is verified
exactly, as a product of 0/1 shingle matrices, in blocks of ``BLOCK`` texts: pairs are
counted, never emitted.

Large subtrees and groups are split into pairs of blocks, each a task's unit of
work, of bounded numbers of texts and of shingles, so no task holds an unbounded group;
exact copies never meet at all.  What is joined to the rows of a group (its size, its
class) is written first, so both sides of the join are dealt out for it and adaptive
execution can split a large group's rows.

The result has a row for each document: its class (least id that a chain of links
reaches), its copy class (least id of the same text) and its number of links, which
counts every other document with similarity >= ``SIMILARITY``, copies included.

Defined results: null text is the empty text; texts without words link to their own
copies only.  A text of 1 to 4 words has one shingle of all its words.  Repeated rows
and repeated or null ids are documents like any other.  Shingles are compared by 64-bit
hashes of their words.  Texts of any length are whole; a text longer than a unit is a block
of its own.  An empty table gives no rows.  Only the id and the text are read by the join;
``stage`` carries the other columns in a struct, so no name can clash, and of rows of equal
id and text keeps the one with the least hash of all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .sketch import HASHES, binary, group_starts, linked_roots, matrix, signatures, whole_groups
from .store import drop, written
from .textcore import SHINGLE, arrow_map, blocks, distinct_by_segment, table

SIMILARITY, RECALL = 0.8, 0.999
TREES, DEPTH = 16, HASHES // 16
#: Texts in half of a unit of comparison, and bytes of their shingle hashes, about.
BLOCK, BLOCK_SHINGLES = 256, 4 << 20
#: Tables of keys up to this size are sent to all executors; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def floor_depth(recall: float = RECALL, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH) -> int:
    """How short matched prefixes must become: the greatest depth at which a pair of that similarity meets in some tree with that probability."""
    for d in range(depth, 1, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    return 1


def least_agreement(similarity: float) -> int:
    """Equal minima that all but one in a million pairs of that similarity have."""
    return int(HASHES * similarity - 5 * np.sqrt(HASHES * similarity * (1 - similarity)))


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _signed(batches):
    for b, blk in blocks(batches):
        h, bounds = blk.shingles(SHINGLE)
        sig = signatures(h, bounds)
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("id"), pa.array(np.diff(bounds)), binary(sig)], names=["node", "id", "size", "sig"])


def _tree_keys(depth: int):
    """Row for each tree: the key of the subtree at ``depth``."""

    def run(batches):
        for b in batches:
            sig = matrix(b.column("sig"), np.uint32, HASHES)
            keys = np.empty((len(sig), TREES), np.int64)
            for t in range(TREES):
                k = np.full(len(sig), t + 1, np.uint64)
                for v in range(t * DEPTH, t * DEPTH + depth):
                    k = (k ^ sig[:, v]) * np.uint64(0x9E3779B97F4A7C15)
                    k ^= k >> np.uint64(29)
                keys[:, t] = k.view(np.int64)
            node = b.column("node")
            which = pa.array(np.tile(np.arange(TREES, dtype=np.int8), len(sig)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), which, node.take(pa.array(np.repeat(np.arange(len(sig)), TREES)))], names=["tree", "t", "node"])

    return run


def _slim(batches):
    """Of each signature what a subtree needs: the path in its tree, and the last byte of every minimum."""
    for b in batches:
        if b.num_rows:
            full = matrix(b.column("sig"), np.uint32, HASHES)
            tree = b.column("t").to_numpy().astype(np.int64)
            path = full[np.arange(len(full))[:, None], tree[:, None] * DEPTH + np.arange(DEPTH)]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("n"), b.column("node"), binary(path), binary(full.astype(np.uint8))], names=["tree", "n", "node", "path", "low"])


def climb(sig: np.ndarray, path: np.ndarray, low: int, floor: int) -> np.ndarray:
    """Groups of one subtree: for each text the first text, in its order, that it is tied to.

    ``path`` is in sorted order.  From the deepest trie nodes up, texts below one node
    that aren't tied yet are compared.
    """
    root = np.arange(len(sig))
    for depth in range(path.shape[1], floor - 1, -1):
        if not root.any():  # one group
            break
        new = np.append(True, (path[1:, :depth] != path[:-1, :depth]).any(1))
        starts = np.append(np.flatnonzero(new), len(path))
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            for r in range(s, e - 1):
                apart = r + 1 + np.flatnonzero(root[r + 1 : e] != root[r])
                if not len(apart):
                    continue
                for other in apart[(sig[apart] == sig[r]).sum(1) >= low]:
                    a, b = root[r], root[other]
                    if a != b:
                        root[root == max(a, b)] = min(a, b)
    return root


def _agreeing(low: int, floor: int):
    """Spanning links of the texts of a unit that the subtree's trie ties together."""

    def run(batches):
        key = ["tree", "i", "j"]
        for t in whole_groups(batches, key):
            path = matrix(t.column("path").combine_chunks(), np.uint32, DEPTH)
            sig = matrix(t.column("low").combine_chunks(), np.uint8, HASHES)
            starts = group_starts(t, key)
            size = np.diff(starts)
            group = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((*path.T[::-1], group))  # each subtree's trie, one after the other
            sig, path = sig[order], path[order]
            root = np.arange(t.num_rows)
            pair = starts[:-1][size == 2]  # most subtrees are two texts
            tied = pair[(sig[pair] == sig[pair + 1]).sum(1) >= low]
            root[tied + 1] = tied
            for g in np.flatnonzero(size > 2):
                s, e = starts[g], starts[g + 1]
                root[s:e] = s + climb(sig[s:e], path[s:e], low, floor)
            at = np.flatnonzero(root != np.arange(len(root)))
            node = t.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(order[at])), node.take(pa.array(order[root[at]]))], names=["a", "b"])

    return run


def _shingled(batches):
    for b, blk in blocks(batches):
        h, bounds = distinct_by_segment(*blk.shingles(SHINGLE))
        off = (bounds * 8).astype(np.int32)
        sets = pa.Array.from_buffers(pa.binary(), blk.n, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(h.tobytes())])
        yield pa.RecordBatch.from_arrays([b.column("node"), sets], names=["node", "shingles"])


def intersections(sets: list[np.ndarray], room: int = 1 << 22) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, as products of 0/1 matrices of so many cells."""
    size = np.array([len(s) for s in sets])
    value, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.full(len(value), -1)
    column[times > 1] = np.arange((times > 1).sum())  # what one set alone has is in no intersection
    col, row = column[code], np.repeat(np.arange(len(sets)), size)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((len(sets), len(sets)))
    columns = int((times > 1).sum())
    width = max(min(room // len(sets), columns), 64)
    for low in range(0, columns, width):
        a, z = np.searchsorted(col, [low, low + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:z], col[a:z] - low] = 1
        out += m @ m.T
    return out


def _verified(similarity: float):
    """For each text of a unit its exact links to the other texts, and spanning links."""

    def run(batches):
        key = ["root", "i", "j"]
        for t in whole_groups(batches, key):
            starts = group_starts(t, key)
            node, own = t.column("node").combine_chunks(), t.column("block").to_numpy()
            i, j, copies, parts = (t.column(c).to_numpy() for c in ("i", "j", "copies", "parts"))
            raw = t.column("shingles").to_pylist()
            links, roots = np.zeros(t.num_rows, np.int64), np.arange(t.num_rows)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in raw[s:e]]
                size = np.array([len(x) for x in sets], float)
                both = intersections(sets)
                hit = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(hit, False)
                if i[s] != j[s]:  # pairs within a block are the business of the unit (block, block)
                    hit &= own[s:e, None] != own[None, s:e]
                links[s:e] = hit @ copies[s:e]
                u, v = np.nonzero(hit)
                roots[s:e] = s + linked_roots(e - s, u, v)
            yield pa.RecordBatch.from_arrays([node, pa.array(links), node.take(pa.array(roots)), pa.array(parts == 1)], names=["node", "links", "to", "whole"])

    return run


def _in_units(df: DataFrame, key: str, parts: Column) -> DataFrame:
    """Deals the rows of each key out to pairs of blocks; adds parts (blocks of the key), block, i and j."""
    df = df.withColumn("parts", parts.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    df = df.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other")
    return df.repartition(F.col(key), F.col("i"), F.col("j")).sortWithinPartitions(key, "i", "j", "node")


def small(keys: DataFrame, row_bytes: int) -> DataFrame:
    """A written table of keys, marked for broadcast if its size allows."""
    return F.broadcast(keys) if keys.count() * row_bytes <= BROADCAST_BYTES else keys


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, nodes).  documents: id, node for every row.  nodes, one for each distinct text: node, rep (its least id), copies, links, class_node, class_id."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("node", text_key())
    schema = f"node binary, id {docs.schema[id_col].dataType.simpleString()}, size bigint, sig binary"
    signed = written(arrow_map(base, _signed, schema), "signatures")
    nodes = written(signed.groupBy("node").agg(F.min(F.struct("id", "size", "sig")).alias("first"), F.count("*").alias("copies")).select("node", F.col("first.id").alias("rep"), "first.size", "first.sig", "copies"), "nodes")
    documents = written(signed.select("id", "node"), "documents")
    drop(signed)
    depth, low = floor_depth(recall, similarity), least_agreement(similarity)

    paths = arrow_map(nodes.where("size > 0").select("node", "sig"), _tree_keys(depth), "tree bigint, t tinyint, node binary")
    met = written(paths.groupBy("tree").agg(F.count("*").alias("n")).where("n > 1"), "subtrees")
    meeting = paths.join(met, "tree").join(nodes.select("node", "sig"), "node").select("tree", "n", "t", "node", "sig")
    units = _in_units(arrow_map(meeting, _slim, "tree bigint, n bigint, node binary, path binary, low binary"), "tree", F.ceil(F.col("n") / BLOCK))
    maybe = components(arrow_map(units.select("tree", "i", "j", "node", "path", "low"), _agreeing(low, depth), "a binary, b binary"), "a", "b")
    drop(met)

    group = written(maybe.join(nodes.select("node", "rep", "copies", "size"), "node"), "groups")
    sizes = written(group.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_SHINGLES)).cast("int").alias("n")), "sizes")
    leads = written(group.select(F.col("node").alias("lead_node"), F.col("rep").alias("lead_id")), "leads")
    texts = base.join(small(leads, 64), F.expr("node = lead_node and id <=> lead_id"), "left_semi")
    sets = arrow_map(texts.select("node", "text"), _shingled, "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    units = _in_units(group.join(sizes, "root").select("root", "n", "node", "copies").join(sets, "node"), "root", F.col("n"))
    verified = written(arrow_map(units, _verified(similarity), "node binary, links bigint, to binary, whole boolean"), "verified")

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    # a group that one unit holds is settled; links across units are joined up
    classes = verified.where("whole").select("node", F.col("to").alias("root")).unionByName(components(verified.where("not whole"), "node", "to"))
    named = classes.join(nodes.select("node", "rep"), "node")
    lead = written(named.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("lead")), "class_leads")
    named = named.join(lead, "root").select("node", F.col("lead.node").alias("class_node"), F.col("lead.rep").alias("class_id"))
    out = nodes.select("node", "rep", "copies").join(links, "node", "left").join(named, "node", "left")
    out = out.select("node", "rep", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("class_node", "node").alias("class_node"), F.when(F.col("class_node").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"))
    return documents, out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, nodes = near_duplicates(table(spark, sf_dir, "documents"))
    nodes = written(nodes, "classes")  # so that both sides are dealt out anew and a hot text can be split
    return documents.join(nodes, "node").select(F.col("id").alias("doc_id"), "class_id", F.col("rep").alias("copy_id"), F.col("links").alias("n_links"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the least id."""
    documents, nodes = near_duplicates(docs)
    nodes = written(nodes.select("node", "rep", (F.col("node") == F.col("class_node")).alias("leads")), "classes")
    rows = written(documents.groupBy("node", "id").agg(F.count("*").alias("times")), "copies")
    judged = rows.join(nodes, "node").select("node", "id", "times", (F.col("leads") & F.col("id").eqNullSafe(F.col("rep"))).alias("stays"))
    judged = written(judged, "judged")
    here = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key().alias("key"), F.col("doc_id").alias("own"))
    same = F.expr("key = node and own <=> id")
    kept = here.join(small(judged.where("not stays or times > 1"), 64), same, "left_anti")  # most rows, which need no shuffle
    again = judged.where("stays and times > 1")
    if not again.isEmpty():
        twins = here.join(small(again, 64), same, "left_semi")
        kept = kept.select("row").unionAll(twins.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row"))
    return kept.select([F.col("row").getField(c).alias(c) for c in docs.columns])
