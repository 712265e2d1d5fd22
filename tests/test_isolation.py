"""Anomalies under threads, at each level, and the serving of concurrent clients."""

from __future__ import annotations

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.isolation import claims, guard, store
from millrace.isolation import history as isolation_history
from millrace.isolation.history import in_cycles
from millrace.isolation.listener import Connection, Listener
from millrace.isolation.queries import at_once, event_history
from millrace.isolation.sessions import Busy, Server, TooLarge
from millrace.isolation.store import Conflict, Database, VersionedTable
from millrace.sources.scratch import new_path


@pytest.fixture
def accounts(spark):
    df = spark.createDataFrame([(1, 100), (2, 100)], "id int, amount int")
    return VersionedTable.create(spark, new_path(spark, "accounts"), df)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("level", ["snapshot", "serializable"])
def test_no_dirty_or_unrepeatable_reads_or_phantoms(spark, accounts, level):
    reader, writer = accounts.begin(level), accounts.begin()
    before = rows(reader.read())
    writer.update(F.col("id") == 1, {"amount": F.lit(0)})
    assert rows(reader.read()) == before
    writer.insert(spark.createDataFrame([(3, 5)], "id int, amount int"))
    writer.commit()
    assert rows(reader.read()) == before and rows(accounts.read()) == [(1, 0), (2, 100), (3, 5)]
    assert reader.commit() == 0


@pytest.mark.parametrize("level", ["snapshot", "serializable"])
def test_lost_update_is_refused(accounts, level):
    a, b = accounts.begin(level), accounts.begin(level)
    for x in (a, b):
        x.update(F.col("id") == 1, {"amount": F.col("amount") + 10})
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert rows(accounts.read()) == [(1, 110), (2, 100)]


def test_write_skew_only_under_snapshot(spark, accounts):
    for level, ends in (("snapshot", 2), ("serializable", 1)):
        ok = 0
        both = [accounts.begin(level), accounts.begin(level)]
        for k, x in enumerate(both):
            total = x.read().agg(F.sum("amount")).first()[0]
            x.insert(spark.createDataFrame([(10 + k, -total)], "id int, amount int"))
        for x in both:
            try:
                x.commit()
                ok += 1
            except Conflict:
                pass
        assert ok == ends


def test_threads_that_append_lose_nothing(spark, accounts):
    gate, failed = threading.Barrier(4), []

    def write(k):
        try:
            x = accounts.begin()
            x.insert(spark.range(100 * k + 10, 100 * k + 60).select(F.col("id").cast("int").alias("id"), F.lit(k).alias("amount")))
            gate.wait()
            x.commit()
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and accounts.read().count() == 202 and accounts.latest() == 4


def test_abort_vacuum_and_time_travel(spark, accounts):
    x = accounts.begin()
    x.delete(F.lit(True))
    x.abort()
    with pytest.raises(Conflict):
        x.commit()
    assert accounts.vacuum() == 1 and rows(accounts.read()) == [(1, 100), (2, 100)]
    y = accounts.begin()
    y.merge(spark.createDataFrame([(2, 7), (9, 9)], "id int, amount int"), "id")
    y.commit()
    assert rows(accounts.read()) == [(1, 100), (2, 7), (9, 9)] and rows(accounts.read(0)) == [(1, 100), (2, 100)]
    with pytest.raises(Conflict):
        VersionedTable.create(spark, accounts.path, accounts.read(0))


def test_clients_are_apart_and_can_be_cancelled(spark):
    server = Server(spark)

    def own_view(k):
        def request(s):
            s.range(k).createOrReplaceTempView("mine")
            s.conf.set("spark.sql.shuffle.partitions", str(k))
            return s.sql("select count(*) as n from mine")

        return request

    got = [server.submit(own_view(k), f"client{k}") for k in range(1, 6)]
    assert [f.result()[0]["n"] for f in got] == [1, 2, 3, 4, 5]
    assert not spark.catalog.tableExists("mine")

    def slow(s):
        return s.range(4, numPartitions=4).select(F.udf(lambda n: time.sleep(20) or n, "long")("id"))

    f = server.submit(slow)
    time.sleep(3)
    server.cancel(f)
    with pytest.raises(Exception, match="cancel"):
        f.result(timeout=15)
    server.close()


# -- commits and vacuum ----------------------------------------------------------------------


def test_five_hundred_races_have_one_winner_each(spark):
    path, rounds = new_path(spark, "races"), 500

    def run(wait, me):
        won = []
        for k in range(rounds):
            wait()
            won.append(claims.claim(spark, f"{path}/{k:012d}.json", b"%d" % me))
        return won

    got = at_once(*(lambda wait, me=me: run(wait, me) for me in range(8)))
    assert [sum(w[k] for w in got) for k in range(rounds)] == [1] * rounds
    names = os.listdir(path.removeprefix("file://"))
    assert len(names) == rounds  # nothing half-made is left
    texts = {r[0].rsplit("/", 1)[-1]: r[1] for r in spark.read.text(path, wholetext=True).select(F.input_file_name(), "value").collect()}
    assert all(texts[f"{k:012d}.json"] == str([w[k] for w in got].index(True)) for k in range(rounds))


def test_a_writer_that_dies_before_its_claim_leaves_no_trace(spark, accounts, monkeypatch):
    x = accounts.begin()
    x.insert(spark.createDataFrame([(3, 5)], "id int, amount int"))

    def die(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(os, "link", die)
        with pytest.raises(OSError, match="gone"):
            x.commit()
    assert accounts.latest() == 0 and rows(accounts.read()) == [(1, 100), (2, 100)]
    y = accounts.begin()
    y.insert(spark.createDataFrame([(4, 6)], "id int, amount int"))
    assert y.commit() == 1 and rows(accounts.read()) == [(1, 100), (2, 100), (4, 6)]


def test_vacuum_spares_open_transactions(spark, accounts):
    x, y = accounts.begin(), accounts.begin()
    x.insert(spark.createDataFrame([(3, 5)], "id int, amount int"))
    y.insert(spark.createDataFrame([(4, 6)], "id int, amount int"))
    y.abort()
    assert accounts.vacuum() == 1 and accounts.vacuum() == 0
    x.commit()
    assert accounts.vacuum() == 0 and rows(accounts.read()) == [(1, 100), (2, 100), (3, 5)]


def test_vacuum_ends_dead_transactions_for_good(spark, accounts):
    dead, done = accounts.begin(), accounts.begin()
    dead.insert(spark.createDataFrame([(3, 5)], "id int, amount int"))
    done.insert(spark.createDataFrame([(4, 6)], "id int, amount int"))
    done.commit()
    time.sleep(0.05)
    assert accounts.vacuum(expire_seconds=0.01) == 1
    with pytest.raises(Conflict, match="ended"):
        dead.commit()
    assert rows(accounts.read()) == [(1, 100), (2, 100), (4, 6)] and not accounts.db.open_transactions()


def test_stores_without_a_claim_are_refused(spark, monkeypatch):
    monkeypatch.setattr(claims, "CLAIMS", {})
    with pytest.raises(ValueError, match="file"):
        claims.claim(spark, f"{new_path(spark, 'x')}/0", b"")


def test_log_with_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(store, "CHECKPOINT", 3)
    t = VersionedTable.create(spark, new_path(spark, "long"), spark.range(1))
    for k in range(8):
        x = t.begin()
        x.insert(spark.range(10 * k + 10, 10 * k + 12))
        if k == 4:
            x.delete(F.col("id") == 0)
        x.commit()
    again = VersionedTable(spark, t.path)
    assert again.db._load("_log/000000000006.checkpoint") and again.read().count() == 16 and again.read(7).count() == 14
    assert rows(again.read(1)) == [(0,), (10,), (11,)]


# -- changes ---------------------------------------------------------------------------------


def test_changes_touch_only_files_they_hit(spark):
    t = VersionedTable.create(spark, new_path(spark, "files"), spark.range(10).coalesce(1).withColumn("file", F.lit("x")))
    for k in (10, 20):
        x = t.begin()
        x.insert(spark.range(k, k + 10).coalesce(1).withColumn("file", F.lit("x")))
        x.commit()
    a, b = t.begin(), t.begin()
    a.update(F.col("id") == 5, {"file": F.lit("a")})
    b.delete(F.col("id") == 25)
    a.commit()
    b.commit()  # another file
    x = t.begin()
    x.merge(spark.createDataFrame([(12, "m"), (99, "m"), (None, "m")], "id bigint, file string"), "id")
    x.delete(F.col("id") == 99)  # its own rows
    x.commit()
    got = {r["id"]: r["file"] for r in t.read().collect()}
    assert got == {**{k: "x" for k in range(30) if k != 25}, 5: "a", 12: "m", None: "m"}
    x = t.begin()
    x.delete(F.col("id") == 10**6)
    assert x.commit() == t.latest() == 5


def test_read_committed_runs_a_statement_again(spark, accounts):
    a, b = accounts.begin("read committed"), accounts.begin("read committed")
    for x in (a, b):
        x.update(F.col("id") == 1, {"amount": F.col("amount") + 10})
        x.insert(spark.createDataFrame([(9, 9)], "id int, amount int"))
    a.commit()
    b.commit()
    assert rows(accounts.read()) == [(1, 120), (2, 100), (9, 9), (9, 9)]


def test_transactions_over_several_tables(spark):
    db = Database.create(spark, new_path(spark, "db"), {"a": spark.range(2), "b": spark.range(3)})
    x = db.begin()
    x.create("c", spark.range(4))
    x.insert("a", x.read("c"))
    reader = db.begin()
    assert "c" not in reader.tables()
    x.commit()
    assert (db.read("a").count(), db.read("c").count(), reader.read("a").count()) == (6, 4, 2)
    with pytest.raises(KeyError):
        reader.read("c")


@pytest.mark.parametrize("level", store.LEVELS)
def test_of_two_creates_one_wins_and_no_row_is_lost(spark, level):
    db = Database.create(spark, new_path(spark, "db"), {"a": spark.range(2)})
    x, y = db.begin(level), db.begin(level)
    x.create("new", spark.createDataFrame([(1,)], "left int"))
    y.create("new", spark.createDataFrame([("r",)], "right string"))
    x.commit()
    with pytest.raises(Conflict):
        y.commit()
    assert rows(db.read("new")) == [(1,)]
    z = db.begin(level)
    with pytest.raises(ValueError, match="exists"):
        z.create("new", spark.range(1))
    z.drop("new")
    z.create("new", spark.range(1))
    w = db.begin(level)
    w.insert("new", spark.createDataFrame([(2,)], "left int"))
    z.commit()
    with pytest.raises(Conflict):  # below snapshot the statement runs again and finds other columns
        w.commit()
    assert rows(db.read("new")) == [(0,)] and rows(db.read("new", 1)) == [(1,)]


def test_columns_change_without_touching_files(spark):
    first = spark.createDataFrame([(1, 2, "x"), (2, None, "y")], "id int, n int, s string")
    db = Database.create(spark, new_path(spark, "db"), {"t": first})
    files = {*db.state(0)["t"]["files"]}
    x = db.begin()
    x.alter("t", add={"extra": "double"}, rename={"s": "label"}, widen={"n": "bigint"})
    x.update("t", "id = 1", {"extra": F.lit(1.5), "n": F.lit(1 << 40)})
    assert rows(x.read("t").select("id", "n", "label", "extra").na.fill(-1)) == [(1, 1 << 40, "x", 1.5), (2, -1, "y", -1.0)]
    x.commit()
    y = db.begin()
    y.alter("t", drop=["label"])
    y.alter("t", add={"label": "string"})  # another column of that name
    y.insert("t", spark.createDataFrame([("new", 3.0, 5, 3)], "label string, extra double, n int, id bigint"))
    y.commit()
    assert rows(db.read("t").select("id", "label").na.fill("-")) == [(1, "-"), (2, "-"), (3, "new")]
    assert files <= {*db.state(2)["t"]["files"]} and rows(db.read("t", 0).na.fill(-1)) == [(1, 2, "x"), (2, -1, "y")]
    assert rows(db.read("t", where="label is null").select("id")) == [(1,), (2,)] and rows(db.read("t", where="extra > 2").select("id")) == [(3,)]
    for bad in ({"drop": ["nothing"]}, {"widen": {"id": "string"}}, {"add": {"ID": "int"}}, {"rename": {"id": "n"}}):
        with pytest.raises(ValueError):
            db.begin().alter("t", **bad)


def test_a_key_that_the_source_has_twice_is_an_error(spark, accounts):
    x = accounts.begin()
    with pytest.raises(ValueError, match="more than once"):
        x.merge(spark.createDataFrame([(1, 5), (1, 6)], "id int, amount int"), "id")
    x.merge(spark.createDataFrame([(None, 5), (None, 6), (2, 7)], "id int, amount int"), "id")
    x.commit()
    assert sorted(r["amount"] for r in accounts.read().collect()) == [5, 6, 7, 100]


@pytest.mark.parametrize("level", ["read committed", "snapshot", "serializable"])
def test_rows_of_one_file_are_changed_side_by_side(spark, level):
    t = VersionedTable.create(spark, new_path(spark, "one"), spark.range(100_000).coalesce(1).withColumn("v", F.lit(0)))
    (file,) = t.files()
    a, b, c = (t.begin(level) for _ in range(3))
    a.update(F.col("id") == 5, {"v": F.lit(1)})
    a.update(F.col("id") == 70_000, {"v": F.lit(1)})
    a.update(F.col("id") == 70_000, {"v": F.col("v") + 1})  # its own new row
    b.delete(F.col("id").isin(6, 70_001))
    c.update(F.col("id") == 70_000, {"v": F.lit(9)})
    a.commit()
    b.commit()
    if level == "read committed":
        c.commit()
    else:
        with pytest.raises(Conflict, match="took"):
            c.commit()
    got = {r["id"]: r["v"] for r in t.read(where="v > 0").collect()}
    assert got == {5: 1, 70_000: 9 if level == "read committed" else 2} and t.read().count() == 99_998
    assert file in t.files() and t.read(0).count() == 100_000
    assert t.db.compact("t") >= 2 and t.db.compact("t") == 0  # files with vectors: the first, and one of a's own
    assert file not in t.files() and t.read().count() == 99_998 and t.read(1).count() == 100_000


def test_compaction_conflicts_with_changes_of_its_files_only(spark):
    t = VersionedTable.create(spark, new_path(spark, "one"), spark.range(10).coalesce(1))
    x = t.begin()
    x.delete(F.col("id") == 3)
    x.commit()
    late, reader = t.begin(), t.begin("serializable")
    late.delete(F.col("id") == 4)
    reader.insert(reader.read(F.col("id") == 5))
    assert t.db.compact("t") == 1
    with pytest.raises(Conflict):
        late.commit()
    reader.commit()  # the same rows in another file
    assert sorted(r[0] for r in t.read().collect()) == [0, 1, 2, 4, 5, 5, 6, 7, 8, 9]


def test_serializable_conflicts_by_predicate(spark):
    df = spark.range(0, 100, 1, 4).select("id", (F.col("id") % 10).alias("g"), F.concat(F.lit("k"), F.col("id")).alias("s"))
    t = VersionedTable.create(spark, new_path(spark, "ranges"), df)
    own = t.db.state(0)["t"]
    assert [len(t.db.files_for(own, w)) for w in ("id < 25", "id = 99 or id = 0", "id > 100", "id in (1, 30, 31)", "s = 'nothing'", "g < 5", "id is null", "not (id >= 50)", "id between 20 and 30", "s like 'k7%'", "id + 1 < 3", "id <=> null", "1 = 0", "id < 2.5D", "id > 99.5D", "g < 0 or id < 0")] == [1, 2, 0, 2, 0, 4, 0, 2, 2, 3, 4, 0, 0, 1, 0, 0]

    def race(mine, theirs):
        a, b = t.begin("serializable"), t.begin("serializable")
        a.insert(a.read(mine).limit(0).unionAll(spark.createDataFrame([(1000, 0, "new")], "id bigint, g bigint, s string")))
        theirs(b)
        b.commit()
        try:
            a.commit()
            return True
        except Conflict:
            return False

    row = lambda i: spark.createDataFrame([(i, i % 10, f"k{i}")], "id bigint, g bigint, s string")
    assert race("id < 10", lambda x: x.update("id = 50", {"g": F.lit(7)}))
    assert race("id < 10 and g = 3", lambda x: x.delete("id = 4"))  # the same file, another row
    assert not race("id < 10 and g = 3", lambda x: x.delete("id = 3"))
    assert race("id > 2000", lambda x: x.insert(row(150)))
    assert not race("id > 140 and id < 160", lambda x: x.insert(row(151)))  # a phantom
    assert not race("g = 70", lambda x: x.update("id = 60", {"g": F.lit(70)}))  # a row that begins to satisfy it
    assert not race(None, lambda x: x.insert(row(152)))
    assert race("s like '%zzz'", lambda x: x.insert(row(153)))  # statistics don't tell, rows do


def test_log_is_trimmed_behind_a_checkpoint(spark, monkeypatch):
    monkeypatch.setattr(store, "CHECKPOINT", 4)
    t = VersionedTable.create(spark, new_path(spark, "long"), spark.range(8).coalesce(1))
    reader = None
    for k in range(11):
        x = t.begin()
        x.delete(F.col("id") == k) if k < 6 else x.insert(spark.range(100 * k, 100 * k + 1))
        x.commit()
        if k == 5:
            reader = t.begin()
            reader.insert(spark.range(7, 8))
    assert t.db.trim() == 5 and t.db.oldest() == 4  # the open transaction began with version 6
    with pytest.raises(ValueError, match="can't be read"):
        VersionedTable(spark, t.path).read(3)
    assert rows(VersionedTable(spark, t.path).read(5)) == [(5,), (6,), (7,)]
    reader.commit()
    before = rows(t.read())
    assert t.db.trim(keep=2) == 4 and t.db.oldest() == 8
    t.db.compact("t")
    dead = t.begin()
    dead.insert(spark.range(3))
    dead.abort()
    assert t.db.vacuum() == 1 and rows(t.read()) == before
    again = VersionedTable(spark, t.path)
    assert rows(again.read()) == before and rows(again.read(9))
    x = again.begin()
    x.insert(spark.range(1))
    assert x.commit() == t.latest()


def test_version_ten_thousand_opens_from_one_checkpoint(spark):
    t = VersionedTable.create(spark, new_path(spark, "long"), spark.range(3))
    folder = t.path.removeprefix("file://") + "/_log"
    empty = '{"txn": "x", "level": "snapshot", "base": 0, "reads": [], "expired": [], "catalog": [], "tables": {}}'
    for v in range(1, 10_000):
        with open(f"{folder}/{v:012d}.json", "w") as f:
            f.write(empty)
    db = Database(spark, t.path)
    db.checkpoint(9_980)
    x = db.begin()
    x.insert("t", spark.range(10, 11))
    assert x.commit() == 10_000
    again = Database(spark, t.path)
    assert rows(again.read("t")) == [(0,), (1,), (2,), (10,)]
    assert len([n for n in again.loaded if n.endswith(".checkpoint")]) == 1 and len(again.loaded) <= 20
    again = Database(spark, t.path)
    again.state(9_999)
    assert len(again.loaded) <= 20
    assert again.trim() == 10_001 and again.oldest() == 10_000
    fresh = Database(spark, t.path)
    assert fresh.vacuum() == 0 and len(fresh.loaded) < 20 and rows(fresh.read("t"))


# -- histories -------------------------------------------------------------------------------


def plain_cycles(history):
    """Transactions in strongly connected components of two or more, by depth-first search over all pairs of neighbours in time."""
    by_key, edges = {}, {}
    for txn, op, k, seq in history:
        by_key.setdefault(k, set()).add((seq, op, txn))
    for ops in by_key.values():
        ops = sorted(ops)
        for i, (s, op, a) in enumerate(ops):
            blocked = None
            for s2, op2, b in ops[i + 1 :]:
                if blocked is not None and s2 > blocked:
                    break  # what comes after the next write by others is reached through it
                if s2 > s and a != b and "w" in (op, op2):
                    edges.setdefault(a, set()).add(b)
                if s2 > s and op2 == "w" and a != b:
                    blocked = s2
    nodes = {h[0] for h in history}
    back = {}
    for a, of in edges.items():
        for b in of:
            back.setdefault(b, set()).add(a)
    order, seen = [], set()
    for n in nodes:
        stack = [(n, iter(edges.get(n, ())))] if n not in seen else []
        seen.add(n)
        while stack:
            at, todo = stack[-1]
            for b in todo:
                if b not in seen:
                    seen.add(b)
                    stack.append((b, iter(edges.get(b, ()))))
                    break
            else:
                order.append(at)
                stack.pop()
    out, done = set(), set()
    for n in reversed(order):
        if n in done:
            continue
        part, stack = {n}, [n]
        done.add(n)
        while stack:
            for b in back.get(stack.pop(), ()):
                if b not in done:
                    done.add(b)
                    part.add(b)
                    stack.append(b)
        if len(part) > 1:
            out |= part
    return out


def cycles(spark, history, **more):
    return {r["txn"] for r in in_cycles(spark.createDataFrame(history, "txn string, op string, k string, seq bigint"), **more).collect()}


def test_cycles_of_histories(spark):
    lost = [("1", "r", "x", 1), ("2", "r", "x", 1), ("1", "w", "x", 2), ("2", "w", "x", 4)]
    serial = [("1", "w", "x", 2), ("2", "r", "x", 3), ("2", "w", "y", 4), ("3", "r", "y", 5)]
    assert cycles(spark, [*lost, *((f"s{t}", op, k, seq + 10) for t, op, k, seq in serial)]) == {"1", "2"}
    assert cycles(spark, []) == set()
    assert cycles(spark, [("1", "w", "x", 1), ("1", "w", "x", 5), ("1", "r", "x", 3), (None, "w", "x", 4)]) == set()
    assert cycles(spark, [("1", "r", "x", 1), ("1", "r", "x", 9), ("2", "w", "x", 5), ("3", "r", "x", 5)]) == {"1", "2"}


def test_cycles_of_random_histories(spark):
    rng = random.Random(3)
    for n_txn, n_keys, spread, grid in ((12, 3, 8, 1024), (60, 8, 3, 4)):
        history = []
        for t in range(n_txn):
            for _ in range(rng.randint(1, 3)):
                history.append((f"t{t}", rng.choice("rrw"), f"k{rng.randrange(n_keys)}", 10 * t + rng.randint(0, 10 * spread)))
        assert cycles(spark, history, grid=grid) == plain_cycles(history)


@pytest.mark.parametrize(("rows", "shrunk"), [(20, 0.7), (20, 0.0), (8, 0.3)])
def test_cycles_of_groups_beyond_one_task(spark, monkeypatch, rows, shrunk):
    """Groups that are solved by slices, and by pivots."""
    monkeypatch.setattr(isolation_history, "ROWS", rows)
    monkeypatch.setattr(isolation_history, "SHRUNK", shrunk)
    rng = random.Random(rows)
    history = [(f"t{t}", rng.choice("rrw"), f"k{rng.randrange(12)}", 5 * t + rng.randint(0, 12)) for t in range(60) for _ in range(3)]
    history += [("long", "r", "apart", 1), ("long", "w", "k1", 290), ("other", "w", "apart", 200), ("other", "r", "k2", 100)]
    want = plain_cycles(history)
    assert 5 < len(want) < 62 and cycles(spark, history) == want


def test_stretches_take_one_round(spark, monkeypatch):
    """Bursts that nothing lasts over are told apart at once, however many there are to a cell of the grid."""
    made = []
    written = isolation_history._Rounds.written
    monkeypatch.setattr(isolation_history._Rounds, "written", lambda self, df: made.append(1) or written(self, df))
    history = [(f"{b}/{j}", op, "k", 10 * b + s) for b in range(40) for j, op, s in ((0, "r", 0), (1, "r", 1), (0, "w", 2), (1, "w", 3), (2, "w", 5))]
    assert cycles(spark, history, grid=4) == {f"{b}/{j}" for b in range(40) for j in (0, 1)} and len(made) < 6


def test_ten_thousand_transactions_of_one_table(spark):
    """Serial ones that each read and write a key of a hundred, one that lasts from the first to the last, and planted cycles of two and three."""
    history = []
    for t in range(10_000):
        k = f"k{t * 7919 % 100}"
        history += [(f"t{t}", "r", k, 2 * t + 1), (f"t{t}", "w", k, 2 * t + 2)]
    for t in (100, 5000, 9000):  # each reads what the other writes later
        history += [(f"t{t}", "r", f"skew{t}", 2 * t), (f"t{t + 1}", "w", f"skew{t}", 2 * t + 4), (f"t{t + 1}", "r", f"other{t}", 2 * t), (f"t{t}", "w", f"other{t}", 2 * t + 2)]
    for j in range(3):
        history += [(f"t{7000 + j}", "r", f"ring{j}", 13_990), (f"t{7000 + (j + 1) % 3}", "w", f"ring{j}", 14_010)]
    history += [("long", "r", "apart", 1), ("long", "r", "apart", 20_001)]
    want = plain_cycles(history)
    assert {"t100", "t101", "t7000", "t7001", "t7002"} <= want and len(want) == 9
    assert cycles(spark, history) == want
    history += [("t9999", "w", "apart", 20_000)]  # now the long one is before and after what the last did
    want = plain_cycles(history)
    assert "long" in want and cycles(spark, history) == want


def test_cycles_of_events(spark, sf):
    events = event_history(spark, sf)
    got = {r["txn"] for r in in_cycles(events).collect()}
    assert len(got) > 100 and got == plain_cycles([tuple(r) for r in events.collect()])


# -- serving -----------------------------------------------------------------------------------


def test_limits_of_the_server(spark):
    server = Server(spark, threads=1, waiting=1, max_rows=5)
    with pytest.raises(TooLarge):
        server.submit(lambda s: s.range(6)).result()
    assert len(server.submit(lambda s: s.range(5)).result()) == 5
    slow = lambda s: s.range(4, numPartitions=4).select(F.udf(lambda n: time.sleep(20) or n, "long")("id"))
    began = time.time()
    first, second = server.submit(slow, timeout=2), server.submit(lambda s: s.range(1))
    with pytest.raises(Busy):
        server.submit(lambda s: s.range(1))
    with pytest.raises(Exception, match="cancel"):
        first.result()
    assert second.result()[0]["id"] == 0 and time.time() - began < 18
    assert sum(len(b) for b in server.stream(spark.range(2500))) == 2500
    server.close()
    assert not server.tags


def test_listener(spark):
    db = Database.create(spark, new_path(spark, "served"), {"t": spark.createDataFrame([(1, 100), (2, 100)], "id int, amount int")})
    with Listener(spark, db.path) as server:
        a, b = Connection(server.address), Connection(server.address)
        a.call("begin", level="serializable")
        b.call("begin", level="serializable")
        a.call("update", table="t", set={"amount": "amount + 1"}, where="id = 1")
        assert sorted(r["amount"] for r in a.query("select * from t")) == [100, 101]
        assert sorted(r["amount"] for r in b.query("select * from t")) == [100, 100]
        b.call("insert", table="t", select="select 3 as id, cast(sum(amount) as int) as amount from t")
        assert a.call("commit") == {"version": 1}
        with pytest.raises(Conflict):
            b.call("commit")
        with pytest.raises(RuntimeError, match="no transaction"):
            b.call("commit")
        with pytest.raises(RuntimeError):
            [*b.query("select nothing from nowhere")]
        assert [r["n"] for r in b.query("select count(*) as n from t")] == [2]
        b.call("begin")
        b.call("delete", table="t", where="id = 2")
        b.close()  # breaks off: its transaction is aborted
        for _ in range(100):
            if not db.open_transactions():
                break
            time.sleep(0.1)
        assert not db.open_transactions() and len([*a.query("select * from t")]) == 2
        assert len([*a.query("select id from range(3000)")]) == 3000
        a.close()


OUTSIDE = [
    "insert overwrite directory 'OUT' using parquet select 1", "create table x as select 1", "create or replace temporary view t as select 1", "create global temporary view g as select 1 as a", "select * from global_temp.shared",
    "select * from parquet.`OUT`", "set spark.sql.shuffle.partitions = 3", "drop view t", "cache table t", "insert into t values (1, 2)", "add jar 'x.jar'", "show tables", "describe t", "select * from default.t",
    "select java_method('java.lang.System', 'getProperty', 'user.home')", "select reflect('java.util.UUID', 'randomUUID') from t", "select * from hidden", "with hidden2 as (select * from hidden) select * from hidden2",
    "with a as (select * from hidden), hidden as (select 1 as x) select * from a", "select (select max(x) from hidden) from t", "select * from t where exists (select 1 from hidden)", "select transform(id) using 'cat' as (x) from t",
    "select * from identifier('hid' || 'den')", "select identifier('java_method')('java.lang.System', 'exit', '0')", "begin select 1; end", "select input_file_name() from t", "explain select 1", "use default", "select * from range(3), hidden", "select system.session.f(1)", "table hidden", "from hidden select x",
]


def test_statements_stay_inside(spark):
    db = Database.create(spark, new_path(spark, "inside"), {"t": spark.createDataFrame([(1, 100)], "id int, amount int")})
    out = new_path(spark, "outside")
    spark.range(1).select(F.lit(7).alias("x")).createOrReplaceGlobalTempView("shared")
    spark.sql("create table if not exists hidden (x int) using parquet")
    try:
        with Listener(spark, db.path) as server:
            a, b = Connection(server.address), Connection(server.address)
            a.call("begin")
            for text in OUTSIDE:
                text = text.replace("OUT", out)
                with pytest.raises(RuntimeError, match="Refused|ParseException"):
                    [*a.query(text)]
                with pytest.raises(RuntimeError, match="Refused|ParseException"):
                    a.call("insert", table="t", select=text)
            for where in ("id in (select x from hidden)", "java_method('java.lang.System', 'exit', '0') is null", "exists (select * from global_temp.shared)"):
                with pytest.raises(RuntimeError, match="Refused"):
                    a.call("delete", table="t", where=where)
                with pytest.raises(RuntimeError, match="Refused"):
                    a.call("update", table="t", set={"amount": f"case when {where} then 1 end"})
            assert not os.path.exists(out.removeprefix("file://")) and [r["amount"] for r in a.query("select * from t")] == [100]
            a.call("create", table="mine", select="select id, amount * 2 as twice from t")
            assert [r["twice"] for r in a.query("select twice from mine")] == [200]
            with pytest.raises(RuntimeError, match="Refused"):  # another client doesn't know the name
                [*b.query("select * from mine")]
            a.call("alter", table="mine", rename={"twice": "double"})
            a.call("commit")
            assert [*b.query("select * from mine")] == [{"id": 1, "double": 200}]
    finally:
        spark.sql("drop table hidden")
        spark.catalog.dropGlobalTempView("shared")


INSIDE = [
    "select * from T", "select t.id, count(*) over (partition by amount order by id) from t", "with a as (select * from t), b as (select * from a) select * from a join b using (id)", "select * from t where id in (select id from t where amount > 3)",
    "select amount, sum(id) from t group by cube(amount, id) having sum(id) > 0 order by 1 limit 3 offset 1", "select * from t union all select * from t except select 1, 2", "select * from values (1, 2) as v(a, b)", "select x from t lateral view explode(array(id, amount)) as x",
    "select * from t, lateral (select t.id + 1 as n)", "select * from t pivot (sum(amount) for id in (1, 2))", "select /*+ broadcast(t) */ distinct id from t", "with recursive r(n) as (select 1 union all select n + 1 from r where n < 5) select * from r", "select 1", "select * from t tablesample (50 percent)", "select id, posexplode(array(1, 2)) from t", "from t |> where id = 1 |> select id",
]


def test_queries_of_many_kinds_are_let_through(spark):
    db = Database.create(spark, new_path(spark, "inside"), {"t": spark.createDataFrame([(1, 100), (2, 3)], "id int, amount int")})
    with Listener(spark, db.path) as server:
        a = Connection(server.address)
        for text in INSIDE:
            assert [*a.query(text)] is not None, text
        a.close()


def test_what_a_query_reads_comes_from_its_plan(spark):
    db = Database.create(spark, new_path(spark, "plans"), {"t": spark.range(100), "u": spark.range(100)})
    with Listener(spark, db.path) as server:
        a, b = Connection(server.address), Connection(server.address)

        def race(query, change):
            a.call("begin", level="serializable")
            [*a.query(query)]
            a.call("insert", table="u", select="select cast(1000 as bigint) as id")
            b.call("begin", level="serializable")
            b.call("delete", table="t", where=change)
            b.call("commit")
            try:
                a.call("commit")
                return True
            except Conflict:
                return False

        assert race("select count(*) from (select * from t where id < 10) where id > 2", "id = 50")
        assert not race("select count(*) from (select * from t where id < 10) where id > 2", "id = 5")
        assert race("select u.id from u join t on u.id = t.id where t.id between 20 and 30", "id = 40")
        assert not race("select u.id from u join t on u.id = t.id where u.id between 20 and 30", "id = 25")  # inferred for t
        assert race("select 't' as t, 'select from t' as x from u where id = 7", "id = 60")  # t isn't read
        assert not race("select max(id) from t", "id = 61")


def test_guard_names_the_tables(spark):
    assert guard.tables_of_query(spark, "with x as (select * from A) select * from x join b on true where exists (select 1 from c)", ["a", "b", "c", "d"]) == {"a", "b", "c"}
    assert guard.tables_of_expression(spark, "id in (select id from a) and upper(s) = 'X'", ["a", "b"]) == {"a"}
