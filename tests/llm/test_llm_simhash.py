"""Fingerprints hash by hash, links bit by bit, and components pair by pair."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import op13_simhash as op

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    runs = [" ".join(w[k : k + 4]) for k in range(max(len(w) - 3, min(len(w), 1)))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius):
    """The least place that chains of links lead to, pair by pair."""
    a, root = np.array(fps, np.uint64), np.arange(len(fps))
    near = np.bitwise_count(a[:, None] ^ a[None]) <= radius
    while True:
        new = np.array([root[row].min() for row in near])
        if (new == root).all():
            return root.tolist()
        root = new


def test_fingerprints_and_components_of_the_table(spark, sf, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    fps = [fingerprint(t) for _, t in rows]
    want = {(d, f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, classes(fps, 4), strict=True)}
    assert {tuple(r) for r in op.query(spark, sf).select("doc_id", "fingerprint", "component_id").collect()} == want


def planted(rng, n):
    """Fingerprints at random, chains of neighbours, and a dense crowd around one."""
    at_random = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    flip = lambda x, k: x ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, k, replace=False))
    chain = [at_random[0]]
    for k in range(40):
        chain.append(flip(chain[-1], 1 + k % 6))
    crowd = [flip(at_random[1], int(rng.integers(0, 4))) for _ in range(n)]
    return np.unique(np.concatenate([at_random, chain, crowd, np.array([0, 1, (1 << 64) - 1], np.uint64)]))


@pytest.mark.parametrize(("full", "block", "radius"), [(1024, 4096, 4), (16, 64, 4), (1, 100, 4), (1024, 37, 3), (64, 4096, 6), (1024, 50, 0)])
def test_no_link_is_lost_or_made(spark, full, block, radius):
    fps = planted(np.random.default_rng(7), 500)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint").repartition(3)
    edges = [(np.int64(r["a"]), np.int64(r["b"])) for r in op.links(nodes, radius, full, block).collect()]
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(place[int(a)]), find(place[int(b)])
        root[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(fps))] == classes(fps, radius)


def test_parts_grow_with_the_number_of_fingerprints():
    assert [len(op.masks(n)) for n in (0, 4 * 10**6, 10**7, 10**10, 10**12)] == [5, 5, 15, 35, 70]
    for n in (10**3, 10**10):
        for a, b in [(0, 0b1111), (0, 1 | 1 << 20 | 1 << 40 | 1 << 63), (5, 5 | 7 << 30)]:
            assert any((a ^ b) & m == 0 for m in op.masks(n))
    with pytest.raises(ValueError, match="radii"):
        op.masks(10, 7)


def test_majority_over_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    bounds = np.array([0, 0, 3, 3, 400, 401, 1000, 1000])
    want = [sum(1 << b for b in range(64) if 2 * int((h[x:y] >> np.uint64(b) & np.uint64(1)).sum()) > y - x) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    for piece in (7, 64, 1 << 16):
        monkeypatch.setattr(op, "_PIECE", piece)
        assert op.majority(h, bounds).tolist() == want


def test_odd_rows(spark):
    long = "Ein langer Text mit vielen Worten " * 50_000
    rows = [(5, None), (3, ""), (9, " \n\t "), (None, "alpha beta gamma delta epsilon"), (8, "Alpha  BETA\ngamma delta epsilon"), (None, "nobody else has this"), (7, long), (6, long), (6, long), (4, "two words"), (2, "Two\x0bWORDS"), (1, "é 𝄞 ß\x00 x y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash")).withColumn("id", F.lit(0))
    got = op.near_duplicates(df)
    assert got.columns == ["doc_id", "fp", "component_id"]
    fps = [fingerprint(t) for _, t in rows]
    least = {}
    for (d, _), c in zip(rows, classes(fps, 4), strict=True):
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(((d, f, least[c]) for (d, _), f, c in zip(rows, fps, classes(fps, 4), strict=True)), key=key)
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got.collect()), key=key) == want
    assert op.near_duplicates(df.limit(0)).count() == 0
