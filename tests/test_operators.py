"""Join operators on nulls, ties and hot keys, and plans that must not be quadratic."""

from __future__ import annotations

import datetime
import os
import re
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import joins, search, selection
from millrace.operators.joins import asof_join, range_join, salted_join
from millrace.sources.tables import table

T0 = datetime.datetime(2024, 1, 1)
few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
moment = st.integers(0, 400_000)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@few
@given(st.lists(st.tuples(st.integers(0, 2), moment), max_size=25), st.lists(st.tuples(st.integers(0, 2), moment, st.integers(0, 9)), max_size=25))
def test_asof(spark, left, right):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    a = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(left)] + [(-1, None, T0)], "id int, k int, t timestamp_ntz")
    b = spark.createDataFrame([(k, at(t), v) for k, t, v in right] + [(0, T0, None)], "k int, t timestamp_ntz, v int")
    got = {r["id"]: r["out"] for r in asof_join(a, b, "k", "t", "v", "out").collect()}
    want = {i: max(((s, v) for q, s, v in right if q == k and s <= t), default=(0, None))[1] for i, (k, t) in enumerate(left)} | {-1: None}
    assert got == want


@few
@given(st.lists(st.integers(-50, 50), max_size=20), st.lists(st.tuples(st.integers(-50, 50), st.integers(-3, 30)), max_size=20))
def test_range(spark, points, spans):
    p = spark.createDataFrame(list(enumerate(points)), "i int, x int")
    s = spark.createDataFrame([(j, a, a + n) for j, (a, n) in enumerate(spans)], "j int, a int, z int")
    got = sorted((r["i"], r["j"]) for r in range_join(p, s, "x", "a", "z", 7).collect())
    assert got == sorted((i, j) for i, x in enumerate(points) for j, (a, n) in enumerate(spans) if a <= x <= a + n)


@pytest.mark.parametrize("bin_rows", [1 << 16, 5])
def test_range_join_of_bursts_and_long_spans(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(joins, "BIN_ROWS", bin_rows)
    points = [(k, 1000 + k % 3) for k in range(60)] + [(k, k * 997 - 20_000) for k in range(100, 160)] + [(200, None), (201, -(1 << 62)), (202, 1 << 62)]
    spans = [(0, 999, 1001), (1, -(1 << 40), 1 << 40), (2, 1002, 1002), (3, 5, 4), (4, None, 9), (5, -20_000, 30_000), (6, -7, 8), (7, 1001, 1001), (8, -(1 << 61), 1 << 61), (9, 1 << 62, 1 << 62)]
    p, s = spark.createDataFrame(points, "i bigint, x bigint"), spark.createDataFrame(spans, "j int, a bigint, z bigint")
    for width in (1, 7, 1 << 20):
        got = sorted((r["i"], r["j"]) for r in range_join(p, s, "x", "a", "z", width).collect())
        assert got == sorted((i, j) for i, x in points for j, a, z in spans if None not in (x, a, z) and a <= x <= z)
    assert range_join(p, s.limit(0), "x", "a", "z").count() == 0
    if bin_rows == 5:  # a burst is dealt out: no key has more than a few of its points
        most = p.withColumn("h", F.pmod(F.xxhash64("i", "x"), F.lit(6))).where("x between 1000 and 1002").groupBy("h", "x").count().agg(F.max("count")).first()[0]
        assert most < 20


@pytest.mark.parametrize(("bins", "rows"), [(1024, 1 << 16), (4, 3), (2, 0), (16, 10)])
def test_percentiles_by_sorting(spark, monkeypatch, bins, rows):
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "SORT_ROWS", rows)
    monkeypatch.setattr(selection, "PASSES", 70)
    rng = np.random.default_rng(1)
    data = [("a", float(v)) for v in rng.normal(size=200)] + [("ties", float(v)) for v in rng.integers(0, 3, 90)] + [("one", 5.0), ("two", -1e300), ("two", 1e300), (None, 1.0), (None, 2.0), ("gone", None)]
    data += [("close", float(np.nextafter(1.0, 2.0) if k % 2 else 1.0)) for k in range(30)]
    df = spark.createDataFrame(data, "k string, v double").repartition(3)
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["fraction"]): r["value"] for r in selection.percentiles(df, ["k"], "v", fractions).collect()}
    groups = {k: np.array([v for q, v in data if q == k and v is not None]) for k in ("a", "ties", "one", "two", "close", None)}
    assert got == {(k, f): pytest.approx(np.quantile(v, f), rel=1e-12) for k, v in groups.items() for f in fractions}
    whole = {r["fraction"]: r["p"] for r in selection.percentiles(df.where("k = 'a'"), [], "v", [0.3], "p").collect()}
    assert whole == {0.3: pytest.approx(np.quantile(groups["a"], 0.3))}
    assert selection.percentiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
    with pytest.raises(ValueError, match="finite"):
        selection.percentiles(spark.createDataFrame([(float("nan"),)], "v double"), [], "v", [0.5])


def test_null_turns_stay_in_chats(spark, tmp_path):
    from millrace.plans.relational import chats_assembled

    rows = [(1, 0, "user", None), (1, 1, None, "b"), (1, 2, "user", "c")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["chat"] for r in chats_assembled(spark, f"file://{tmp_path}").collect()] == ["user: \n: b\nuser: c"]


def test_salted_join(spark, monkeypatch):
    a = spark.createDataFrame([(1, k) for k in range(200)] + [(2, 7), (2, 7), (None, 3)], "key int, v int")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (3, "n"), (None, "no")], "key int, w string")
    for share in (1000, 3, 1):
        monkeypatch.setattr(joins, "HOT_SHARE", share)
        got = salted_join(a, b, "key")
        assert got.exceptAll(a.join(b, "key")).count() == 0 and got.count() == 204


def test_joins_take_any_column_names(spark):
    names = ["bucket__", "side__", "value__", "here__", "last__", "carry__", "bin__", "salt__", "hot__", "n__", "_b", "_bin", "_salt"]
    a = spark.createDataFrame([(1, T0, 5, *names), (None, T0, 6, *names), (2, None, 7, *names)], ", ".join(["k int, t timestamp_ntz, x int", *(f"{n} string" for n in names)]))
    b = spark.createDataFrame([(1, T0, 9), (1, T0, 8)], "k int, t timestamp_ntz, v int")
    out = asof_join(a, b, "k", "t", "v", "out")
    assert out.columns == [*a.columns, "out"] and {(r["x"], r["out"]) for r in out.collect()} == {(5, 9), (6, None), (7, None)}
    spans = spark.createDataFrame([(4, 5, "bin__")], "low int, high int, bin__ string").withColumnRenamed("bin__", "bin___")
    assert range_join(a, spans, "x", "low", "high", 3).columns == [*a.columns, *spans.columns]
    assert salted_join(a, b.select("k", "v"), "k").columns == [*a.columns, "v"]
    assert asof_join(a.limit(0), b.limit(0), "k", "t", "v", "out").count() == 0


def test_asof_buckets_follow_the_fullest_day(spark, monkeypatch):
    monkeypatch.setattr(joins, "BUCKET_ROWS", 10)
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    a = spark.createDataFrame([(1, at(60 * k)) for k in range(300)], "k int, t timestamp_ntz")
    b = spark.createDataFrame([(1, at(3600 * k), k) for k in range(3)], "k int, t timestamp_ntz, v int")
    assert all(r["out"] == min((r["t"] - T0).seconds // 3600, 2) for r in asof_join(a, b, "k", "t", "v", "out").collect())


def test_lateral_ranks_by_its_order(spark, tmp_path):
    """The rows are those of the order, however a shuffle deals them; null keys come last, as in DuckDB."""
    from millrace import catalog

    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(None, 1, 5.0), (10, 1, 5.0), (11, 1, 5.0), (12, 1, None), (20, 2, 1.0), (21, 2, 9.0), (22, 2, 3.0)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["j11_lateral"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(1, 10), (1, 11), (2, 21), (2, 22)}
    ranks = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number() windowspecdefinition" in line]
    assert ranks and all(re.search(r"windowspecdefinition\(o_custkey#\d+L?, o_totalprice#\d+ DESC NULLS LAST, o_orderkey#\d+L? ASC NULLS LAST", line) for line in ranks)


def plain_nearest(x, ids, queries, k, metric):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x
    out = {}
    for q in queries:
        s = np.round(u @ u[q], 9)
        s[ids == ids[q]] = -np.inf
        out[int(ids[q])] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


@pytest.mark.parametrize(("metric", "cell", "part", "block"), [("cosine", 2048, 8192, 4096), ("cosine", 10, 7, 2), ("dot", 6, 3, 100), ("dot", 2048, 20, 3)])
def test_nearest_by_brute_force(spark, monkeypatch, metric, cell, part, block):
    for name, value in (("CELL_ROWS", cell), ("PART_ROWS", part), ("BLOCK_QUERIES", block)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6))
    x[40:50] = x[3]  # ties
    x[60] = 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(200, None), (201, [1.0]), (202, [None] * 6)], "id bigint, v array<double>").repartition(4)
    got = {}
    for r in sorted(search.nearest(df, df.where("id % 10 = 0").unionAll(df.where("id = 10")), "id", "v", 5, metric).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["id"])
    assert got == plain_nearest(x, np.arange(90), range(0, 90, 10), 5, metric)
    assert search.nearest(df.limit(0), df.limit(0), "id", "v").count() == 0 and search.nearest(df.limit(0), df, "id", "v").count() == 0


def test_cells_are_passed_over_where_vectors_cluster(spark, monkeypatch):
    monkeypatch.setattr(search, "CELL_ROWS", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.05
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, v array<double>").repartition(3)
    asked = df.where("id % 20 = 0")
    for metric in ("cosine", "dot"):
        s = search.search(df, asked, "id", "v", metric)
        got = {}
        for r in sorted(s.nearest(asked, "id", "v", 4).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query"], []).append(r["id"])
        assert got == plain_nearest(x, np.arange(3000), range(0, 3000, 20), 4, metric)
        assert s.share() < (0.15 if metric == "cosine" else 0.6)


def test_search_shuffles_no_row_for_each_block(spark, monkeypatch):
    """Evenly spread vectors, of which nothing is passed over: what is shuffled stays within a few times the vectors; rows without id are found by none."""
    monkeypatch.setattr(search, "CELL_ROWS", 20)
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    on_disk = lambda: {f: os.path.getsize(f) for d in dirs for at, _, names in os.walk(d) for n in names if os.path.exists(f := os.path.join(at, n))}
    x = np.random.default_rng(6).normal(size=(2000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(None, x[0].tolist())], "id bigint, v array<double>").repartition(3)
    asked, before = df.where("id % 20 = 0"), on_disk()
    s = search.search(df, asked, "id", "v")
    got = {}
    for r in sorted(s.nearest(asked, "id", "v", 4).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["id"])
    assert got == plain_nearest(x, np.arange(2000), range(0, 2000, 20), 4, "cosine")
    assert sum(n for f, n in on_disk().items() if f not in before) < 10 * x.nbytes


def test_sample_and_checksums(spark, sf):
    import xxhash

    from millrace import catalog

    q = catalog.queries()
    n, all_ids = table(spark, sf, "events").count(), {r[0] for r in table(spark, sf, "events").select("event_id").collect()}
    one, two = ({r[0] for r in q["f5_sample"](spark, sf).collect()} for _ in range(2))
    assert one == two and one < all_ids and abs(len(one) - 0.1 * n) < 5 * (0.09 * n) ** 0.5
    texts = {r["doc_id"]: r["text"].encode() for r in table(spark, sf, "documents").collect()}
    for r in q["x9_checksums"](spark, sf).collect():
        t = texts[r["doc_id"]]
        assert r["crc"] == zlib.crc32(t) and r["xx"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(t, 42)


def test_a_batch_that_runs_again_replaces_itself(spark):
    from millrace.sources.scratch import new_path
    from millrace.streaming.queries import collected, sink

    path = new_path(spark, "sink")
    for number, rows in ((0, 3), (1, 4), (1, 4)):
        sink(path)(spark.range(rows), number)
    assert collected(spark, path, spark.range(1).schema).count() == 7


@pytest.mark.parametrize("name", ["j9_range", "j10_asof", "j11_lateral", "j12_star", "j13_salted"])
def test_no_quadratic_joins(spark, sf, name):
    from millrace import catalog

    assert "Cartesian" not in plan(catalog.queries()[name](spark, sf)) and "NestedLoop" not in plan(catalog.queries()[name](spark, sf))


def test_filters_and_columns_reach_the_scan(spark, sf):
    from millrace import catalog

    text = plan(catalog.queries()["pricing_summary"](spark, sf))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in text and "l_partkey" not in text
    assert "WindowGroupLimit" in plan(catalog.queries()["w9_top_per_group"](spark, sf))
    assert "TakeOrderedAndProject" in plan(catalog.queries()["l2_top_k"](spark, sf))
    assert table(spark, sf, "region").count() == 5
