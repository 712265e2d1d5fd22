"""Transactions as queries: levels, races of real threads, a server's clients, and a checker of histories."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path
from ..sources.tables import table
from . import history
from .listener import Connection, Listener
from .sessions import Server
from .store import LEVELS, Conflict, Database, Transaction, VersionedTable


def _customers(spark: SparkSession, sf_dir: str) -> VersionedTable:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return VersionedTable.create(spark, new_path(spark, "table"), c)


def _new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that began before a writer committed."""
    t = _customers(spark, sf_dir)
    reader = t.begin()
    writer = t.begin()
    writer.insert(_new_rows(spark, sf_dir))
    writer.commit()
    return reader.read()


def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers that only add rows don't conflict."""
    t = _customers(spark, sf_dir)
    a, b = t.begin(), t.begin()
    a.insert(_new_rows(spark, sf_dir))
    b.insert(_new_rows(spark, sf_dir))
    a.commit()
    b.commit()
    return t.read()


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir)
    x = t.begin()
    x.delete(F.col("c_acctbal") < 0)
    x.commit()
    return t.read()


def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir)
    x = t.begin()
    x.update(F.col("c_nationkey") == 3, {"c_acctbal": F.lit(0.0)})
    x.commit()
    return t.read()


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir)
    x = t.begin("serializable")
    s = table(spark, sf_dir, "supplier")
    x.merge(s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal")), "c_custkey")
    x.commit()
    return t.read()


def aborted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir)
    x = t.begin()
    x.delete(F.lit(True))
    x.abort()
    t.vacuum()
    return t.read()


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir)
    for nation in (1, 2):
        x = t.begin()
        x.delete(F.col("c_nationkey") == nation)
        x.commit()
    return t.read(version=1)


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four clients at once; each has its own view of the same name."""
    names = ["orders", "customer", "part", "supplier"]
    server = Server(spark)

    def request(name: str):
        def run(s: SparkSession) -> DataFrame:
            table(s, sf_dir, name).createOrReplaceTempView("mine")
            return s.sql("select count(*) as n from mine")

        return run

    got = [(n, server.submit(request(n), n)) for n in names]
    rows = [(n, f.result()[0]["n"]) for n, f in got]
    server.close()
    return spark.createDataFrame(rows, "client string, n bigint")


def begin_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction reads the version it began with, however many come after; version and rows that it sees."""
    t = _customers(spark, sf_dir)
    reader = t.begin()
    for nation in range(3):
        x = t.begin()
        x.delete(F.col("c_nationkey") == nation)
        x.commit()
    return reader.read().agg(F.count("*").alias("n")).withColumn("version", F.lit(reader.whole.version)).withColumn("latest", F.lit(t.latest()))


def at_once(*work: Callable[[Callable[[], None]], object]) -> list:
    """Runs functions in threads of their own; each gets a barrier to wait at.  Returns results, or Conflicts."""
    gate = threading.Barrier(len(work))

    def one(f):
        try:
            return f(lambda: gate.wait(600))
        except Conflict as e:
            return e

    with ThreadPoolExecutor(len(work)) as pool:
        return [f.result() for f in [pool.submit(one, f) for f in work]]


def tried_again(t, level: str, change: Callable) -> None:
    """Runs a change in a transaction until it commits."""
    while True:
        x = t.begin(level)
        change(x)
        try:
            x.commit()
            return
        except Conflict:
            continue


def commit_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight threads at once want the next versions of one table, each with an eighth of the customers; no row is lost or doubled, and each gets a version of its own."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    t = VersionedTable.create(spark, new_path(spark, "race"), c.limit(0))

    def one(wait, k):
        x = t.begin()
        x.insert(c.where(F.pmod("c_custkey", F.lit(8)) == k))
        wait()
        return x.commit()

    won = at_once(*(lambda wait, k=k: one(wait, k) for k in range(8)))
    if sorted(won) != [*range(1, 9)]:
        raise AssertionError(f"versions {won}")
    return t.read()


def _race(first: Callable, again: Callable):
    """Two transactions of two threads at each level, both begun before either changes anything and both done before either commits; who gets a conflict tries again. The table's rows then."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = []
        for level in ("snapshot", "serializable"):
            t = _customers(spark, sf_dir)

            def one(wait, k, t=t, level=level):
                x = t.begin(level)
                wait()
                first(x)
                wait()
                try:
                    x.commit()
                except Conflict:
                    tried_again(t, level, again)

            at_once(lambda wait, one=one: one(wait, 0), lambda wait, one=one: one(wait, 1))
            out.append(t.read().withColumn("level", F.lit(level)))
        return out[0].unionAll(out[1])

    return run


def _raise_balance(x) -> None:
    x.update(F.col("c_nationkey") == 3, {"c_acctbal": F.col("c_acctbal") + 1})


def _copy_of_first(x) -> None:
    """Adds a copy of customer 1 under the negative of how many rows there are."""
    n = x.read().count()
    x.insert(x.read("c_custkey = 1").withColumn("c_custkey", F.lit(-n).cast("bigint")))


def _pair(spark: SparkSession, sf_dir: str) -> Database:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return Database.create(spark, new_path(spark, "pair"), {"left": s, "right": s})


def skew_across_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of two threads counts one table and adds a row to the other; under snapshot both count the same, under serializable one must count again. The rows of both tables."""
    out = []
    for level in ("snapshot", "serializable"):
        db = _pair(spark, sf_dir)

        def change(x, read, write):
            n = x.read(read).count()
            x.insert(write, spark.createDataFrame([(-n, 0.0)], "s_suppkey bigint, s_acctbal double"))

        def one(wait, read, write, db=db, level=level):
            x = db.begin(level)
            wait()
            change(x, read, write)
            wait()
            try:
                x.commit()
            except Conflict:
                tried_again(db, level, lambda y: change(y, read, write))

        at_once(lambda w, one=one: one(w, "left", "right"), lambda w, one=one: one(w, "right", "left"))
        out += [db.read(t).withColumn("level", F.lit(level)) for t in ("left", "right")]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def both_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit over two tables: rows move from one to the other, and no version shows them twice or nowhere."""
    db = _pair(spark, sf_dir)
    x = db.begin()
    move = F.col("s_suppkey") % 2 == 0
    x.insert("right", x.read("left").where(move).withColumn("s_suppkey", F.col("s_suppkey") + 1000000))
    x.delete("left", move)
    x.commit()
    sides = [db.read(t, v).agg(F.count("*").alias("n")).select(F.lit(t).alias("side"), F.lit(v).alias("version"), "n") for t in ("left", "right") for v in (0, 1)]
    return sides[0].unionAll(sides[1]).unionAll(sides[2]).unionAll(sides[3])


def touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of one nation in a table of eight files, each of which has some of it: the rows of each nation that are still in those files, and those that aren't."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    eight = [c.where(F.pmod(F.hash("c_custkey"), F.lit(8)) == k).coalesce(1) for k in range(8)]
    t = VersionedTable.create(spark, new_path(spark, "table"), eight[0])
    for part in eight[1:]:
        x = t.begin()
        x.insert(part)
        x.commit()
    before = t.files()
    x = t.begin()
    x.update(F.col("c_nationkey") == 3, {"c_acctbal": F.lit(0.0)})
    x.commit()
    now = t.db.frame(t.db.state(t.latest())["t"], mark="mark")
    return now.groupBy("c_nationkey", F.col("mark.file").isin(before).alias("in_first_files")).agg(F.count("*").alias("n"))


def _threads(t: VersionedTable, level: str, *changes: Callable) -> None:
    """Each change in a transaction and thread of its own: all begin before any changes, all have changed before any commits."""

    def one(wait, change):
        x = t.begin(level)
        wait()
        change(x)
        wait()
        return x.commit()

    got = at_once(*(lambda wait, c=c: one(wait, c) for c in changes))
    if lost := [g for g in got if isinstance(g, Conflict)]:
        raise lost[0]


def one_file_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three transactions change different rows of one file at once; all commit."""
    t = VersionedTable.create(spark, new_path(spark, "table"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").coalesce(1))
    half = lambda k, what: lambda x: x.update(F.col("c_custkey") % 3 == k, {"c_acctbal": F.lit(what)})
    _threads(t, "snapshot", half(0, 0.0), half(1, 1.0), lambda x: x.delete(F.col("c_custkey") % 3 == 2))
    return t.read()


def disjoint_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two serializable transactions read and change rows of their own nations, and add what they have read; both commit."""
    t = _customers(spark, sf_dir)

    def change(low: int, high: int):
        mine = F.col("c_nationkey").between(low, high)

        def run(x):
            x.insert(x.read(mine & (F.col("c_acctbal") > 9000)).withColumn("c_custkey", F.col("c_custkey") + 1000000))
            x.update(mine & (F.col("c_acctbal") < 0), {"c_acctbal": F.lit(0.0)})

        return run

    _threads(t, "serializable", change(0, 11), change(12, 24))
    return t.read()


def pruned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of a table whose files hold ranges: only files that could have rows of it are opened."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    t = VersionedTable.create(spark, new_path(spark, "table"), o.repartitionByRange(32, "o_orderdate"))
    x = t.begin()
    x.delete("o_orderdate < timestamp_ntz'1996-01-01' and o_totalprice > 400000")
    x.commit()
    return t.read(where="o_orderdate >= timestamp_ntz'1995-12-01' and o_orderdate < timestamp_ntz'1996-02-01'")


def changed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns renamed, widened, dropped, added, and added again under an old name; files from before and after are read side by side, and time travel shows the old columns."""
    t = _customers(spark, sf_dir)
    x = Transaction(t.db, "serializable")
    x.alter("t", rename={"c_acctbal": "balance"}, widen={"c_nationkey": "bigint"}, add={"grade": "string", "note": "int"})
    s = table(spark, sf_dir, "supplier")
    x.insert("t", s.select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("balance"), F.lit("new").alias("grade"), F.lit(1).alias("note")))
    x.update("t", "balance < 0", {"grade": F.lit("low")})
    x.commit()
    y = Transaction(t.db, "snapshot")
    y.alter("t", drop=["note"])
    y.alter("t", add={"note": "bigint"})
    y.commit()
    now, then = t.read(), t.read(version=0)
    return now.select("c_custkey", "c_nationkey", "balance", "grade", "note", F.lit("now").alias("at")).unionAll(then.select("c_custkey", F.col("c_nationkey").cast("bigint"), "c_acctbal", F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit("then")))


def created_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two threads create one table; who comes second gets a conflict and adds its rows instead."""
    db, s = _pair(spark, sf_dir), table(spark, sf_dir, "supplier")

    def one(wait, k):
        mine = s.where(F.col("s_suppkey") % 2 == k).select("s_suppkey", F.lit(k).alias("writer"))
        x = db.begin("read committed" if k else "snapshot")
        wait()
        x.create("new", mine)
        wait()
        try:
            x.commit()
        except Conflict:
            again = db.begin()
            again.insert("new", mine)
            again.commit()

    at_once(lambda w: one(w, 0), lambda w: one(w, 1))
    return db.read("new")


def kept_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database after many commits, with files compacted, its log trimmed and its garbage removed; the rows are those of the last version."""
    t = _customers(spark, sf_dir)
    for nation in range(5):
        x = t.begin()
        x.update(F.col("c_nationkey") == nation, {"c_acctbal": F.col("c_acctbal") + nation})
        x.commit()
    t.db.checkpoint(t.latest())
    t.db.compact("t")
    t.db.trim()
    t.db.vacuum()
    return VersionedTable(spark, t.path).read()


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which anomaly happens at which level."""
    rows = []
    n = lambda df: df.count()
    one = lambda: spark.createDataFrame([(7, 7.0)], "s_suppkey bigint, s_acctbal double")
    for level in LEVELS:
        db = _pair(spark, sf_dir)
        reader, writer = db.begin(level), db.begin()
        before = n(reader.read("left"))
        writer.insert("left", one())
        rows.append((level, "dirty read", n(reader.read("left")) != before))
        writer.commit()
        rows.append((level, "phantom", n(reader.read("left")) != before))
        reader.abort()
        a, b = db.begin(level), db.begin(level)
        low = [x.read("right").agg(F.min("s_suppkey")).first()[0] for x in (a, b)]
        lost = True
        for x, v in ((a, 1.0), (b, 2.0)):
            x.update("right", F.col("s_suppkey") == low[0], {"s_acctbal": F.lit(v)})
        a.commit()
        try:
            b.commit()
        except Conflict:
            lost = False
        rows.append((level, "lost update", lost))
        db = _pair(spark, sf_dir)
        a, b = db.begin(level), db.begin(level)
        for x, read, write in ((a, "left", "right"), (b, "right", "left")):
            n(x.read(read))
            x.insert(write, one())
        a.commit()
        try:
            b.commit()
            skew = True
        except Conflict:
            skew = False
        rows.append((level, "write skew", skew))
    return spark.createDataFrame(rows, "level string, anomaly string, happens boolean")


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clients of the server raise the same balances in serializable transactions, trying again after a conflict; no raise is lost."""
    db = _pair(spark, sf_dir)

    def client(address: tuple, raises: int) -> None:
        c = Connection(address)
        while raises:
            try:
                c.call("begin", level="serializable")
                n = [*c.query("select count(*) as n from left")][0]["n"]
                c.call("update", table="right", set={"s_acctbal": f"s_acctbal + {n} / {n}"}, where="s_suppkey < 3")
                c.call("commit")
                raises -= 1
            except Conflict:  # the commit has ended the transaction
                continue
        c.close()

    with Listener(spark, db.path) as server, ThreadPoolExecutor(3) as pool:
        for f in [pool.submit(client, server.address, 2) for _ in range(3)]:
            f.result()
    return db.read("right")


def history_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a race for write skew, of two threads, and serial transactions after it: how many transactions committed, and how many of them are in cycles."""
    rows = []
    for level in ("snapshot", "serializable"):
        db = _pair(spark, sf_dir)

        def one(wait, read, write, db=db, level=level):
            x = db.begin(level)
            wait()
            x.insert(write, x.read(read).limit(1))
            wait()
            return x.commit()

        at_once(lambda w, one=one: one(w, "left", "right"), lambda w, one=one: one(w, "right", "left"))
        for _ in range(2):
            x = Transaction(db, level)
            x.update("left", F.col("s_suppkey") == 1, {"s_acctbal": F.lit(0.0)})
            x.commit()
        rows.append((level, db.latest(), history.in_cycles(db.history()).count()))
    return spark.createDataFrame(rows, "level string, committed bigint, in_cycles bigint")


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a history: a user's events of a day are a transaction that reads one of ten keys, or writes it if something was bought."""
    e = table(spark, sf_dir, "events")
    txn = F.concat_ws("/", F.col("user_id"), F.to_date("ts"))
    op = F.when(F.col("event_type") == "purchase", "w").otherwise("r")
    return e.select(txn.alias("txn"), op.alias("op"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("k"), F.col("event_id").alias("seq"))


def event_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users that no serial order of all days explains."""
    return history.in_cycles(event_history(spark, sf_dir))


_BASE = "select c_custkey, c_nationkey, c_acctbal from customer"
_NEW = "select s_suppkey + 1000000, s_nationkey, s_acctbal from supplier"
_LEVELS = "(values ('snapshot'), ('serializable')) as l(level)"
_HAPPENS = {"dirty read": 1, "phantom": 2, "lost update": 2, "write skew": 3}  # at so many of LEVELS
QUERIES = {
    "i1_concurrent_clients": (clients, "select 'orders' as client, count(*) as n from orders union all select 'customer', count(*) from customer union all select 'part', count(*) from part union all select 'supplier', count(*) from supplier"),
    "i2_served_transactions": (served, "select s_suppkey, case when s_suppkey < 3 then s_acctbal + 1 + 1 + 1 + 1 + 1 + 1 else s_acctbal end as s_acctbal from supplier"),
    "k1_begin_pins": (begin_pins, "select count(*) as n, 0 as version, 3 as latest from customer"),
    "k2_snapshot_read": (snapshot, _BASE),
    "k3_insert": (inserted, f"{_BASE} union all {_NEW} union all {_NEW}"),
    "k3_delete": (deleted, f"{_BASE} where not c_acctbal < 0"),
    "k3_update": (updated, "select c_custkey, c_nationkey, case when c_nationkey = 3 then 0.0::double else c_acctbal end as c_acctbal from customer"),
    "k3_merge": (merged, f"{_BASE} where c_custkey not in (select s_suppkey from supplier) union all select s_suppkey, s_nationkey, s_acctbal from supplier"),
    "k3_touched_files": (touched_files, "select c_nationkey, c_nationkey <> 3 as in_first_files, count(*) as n from customer group by all"),
    "k4_changed_columns": (changed_columns, """select c_custkey, cast(c_nationkey as bigint) as c_nationkey, c_acctbal as balance, case when c_acctbal < 0 then 'low' end as grade, cast(null as bigint) as note, 'now' as at from customer
      union all select s_suppkey + 1000000, s_nationkey, s_acctbal, case when s_acctbal < 0 then 'low' else 'new' end, null, 'now' from supplier union all select c_custkey, c_nationkey, c_acctbal, null, null, 'then' from customer"""),
    "k4_created_once": (created_once, "select s_suppkey, cast(s_suppkey % 2 as integer) as writer from supplier"),
    "k5_rows_of_one_file": (one_file_two_writers, "select c_custkey, c_nationkey, cast(c_custkey % 3 as double) as c_acctbal from customer where c_custkey % 3 < 2"),
    "k6_disjoint_ranges": (disjoint_ranges, "select c_custkey, c_nationkey, greatest(c_acctbal, 0.0) as c_acctbal from customer union all select c_custkey + 1000000, c_nationkey, c_acctbal from customer where c_acctbal > 9000"),
    "k6_pruned_read": (pruned_read, "select o_orderkey, o_orderdate, o_totalprice from orders where o_orderdate >= timestamp '1995-12-01' and o_orderdate < timestamp '1996-02-01' and not (o_orderdate < timestamp '1996-01-01' and o_totalprice > 400000)"),
    "k7_kept_log": (kept_log, "select c_custkey, c_nationkey, case when c_nationkey < 5 then c_acctbal + c_nationkey else c_acctbal end as c_acctbal from customer"),
    "k4_commit_race": (commit_race, _BASE),
    "k4_both_tables": (both_tables, "select 'left' as side, 0 as version, count(*) as n from supplier union all select 'left', 1, count(*) filter (where s_suppkey % 2 <> 0) from supplier union all select 'right', 0, count(*) from supplier union all select 'right', 1, count(*) + count(*) filter (where s_suppkey % 2 = 0) from supplier"),
    "k5_lost_update": (_race(_raise_balance, _raise_balance), f"select c_custkey, c_nationkey, case when c_nationkey = 3 then c_acctbal + 1 + 1 else c_acctbal end as c_acctbal, level from customer, {_LEVELS}"),
    "k6_write_skew": (_race(_copy_of_first, _copy_of_first), f"select c_custkey, c_nationkey, c_acctbal, level from customer, {_LEVELS} union all select -n - (case when level = 'serializable' then k else 0 end), c_nationkey, c_acctbal, level from customer, (select count(*) as n from customer), range(2) t(k), {_LEVELS} where c_custkey = 1"),
    "k6_skew_across_tables": (skew_across_tables, f"select s_suppkey, s_acctbal, level from supplier, range(2) t(k), {_LEVELS} union all select -n - (case when level = 'serializable' then k else 0 end), 0.0::double, level from (select count(*) as n from supplier), range(2) t(k), {_LEVELS}"),
    "k7_abort": (aborted, _BASE),
    "k8_time_travel": (time_travel, f"{_BASE} where c_nationkey <> 1"),
    "k9_history_cycles": (history_cycles, "select 'snapshot' as level, cast(4 as bigint) as committed, cast(2 as bigint) as in_cycles union all select 'serializable', 3, 0"),
    "k9_event_cycles": (event_cycles, None),
    "k10_levels": (anomalies, " union all ".join(f"select '{v}' as level, '{a}' as anomaly, {str(k < n).lower()} as happens" for a, n in _HAPPENS.items() for k, v in enumerate(LEVELS))),
}
