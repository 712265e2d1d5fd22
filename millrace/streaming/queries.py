"""Windows, watermarks, deduplication, joins and keyed state over the events stream.

Every query reads the table as a stream, runs until all of it is taken in
(``availableNow``), writes through ``foreachBatch`` to the shared folder and returns
what was written.  ``ts`` has no time zone, which watermarks don't take, so it is cast
to an instant first and back in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.scratch import file_system, new_path
from ..sources.tables import table

NTZ = "timestamp_ntz"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, whether it is a file or a folder of files."""
    fs, path = file_system(spark, f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    stream = reader.parquet(f"{sf_dir}/events.parquet") if fs.getFileStatus(path).isDirectory() else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sink(path: str, mode: str = "append"):
    """Writes a micro-batch under its id, so that one that runs again replaces itself; a complete result replaces the one before."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    return save


def collected(spark: SparkSession, path: str, schema) -> DataFrame:
    """What the batches of a sink have written."""
    whole = StructType([*schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(whole).parquet(path).drop("batch")


def drained(stream: DataFrame, mode: str, progress: str | None = None) -> DataFrame:
    """Runs the stream over all there is; ``progress`` is where its state stays."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")  # there may be no batch
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", progress or new_path(spark, "progress")).trigger(availableNow=True).foreachBatch(sink(path, mode)).start()
    query.awaitTermination()
    return collected(spark, path, stream.schema)


def file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(events(spark, sf_dir).where("event_type = 'error'").select("event_id", "user_id"), "append")


def _windows(*size: str):
    """Update mode: a batch writes the windows it has changed, of which the last count holds; state goes behind the watermark."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", *size), "event_type").agg(F.count("*").alias("n"))
        return drained(n, "update").groupBy(F.col("window.start").cast(NTZ).alias("start"), "event_type").agg(F.max("n").alias("n"))

    return run


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a session comes out, and its state goes, once the watermark has passed its end."""
    n = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return drained(n, "append").select("user_id", F.col("session_window.start").cast(NTZ).alias("start"), "n")


def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a window comes out once the watermark has passed its end."""
    n = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return drained(n, "append").select(F.col("window.start").cast(NTZ).alias("start"), "n")


#: How late a repeated event may come; what is known of older ones goes.
LATE = "2 days"


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = events(spark, sf_dir).select("event_id", "ts").unionByName(events(spark, sf_dir).select("event_id", "ts"))
    return both.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(_twice(spark, sf_dir), "append").select("event_id")


def dedup_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What deduplication still knows at the end of the stream, read from its state store."""
    progress = new_path(spark, "progress")
    drained(_twice(spark, sf_dir), "append", progress)
    return spark.read.format("statestore").load(progress).select(F.col("key.event_id").alias("event_id"))


def static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return drained(events(spark, sf_dir).select("event_id", "user_id").join(c, "user_id"), "append").select("event_id", "c_mktsegment")


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the same user's clicks of the hour before; state is bounded by the watermarks."""
    p = events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("bought")).withWatermark("bought", "2 hours")
    c = events(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("who"), F.col("ts").alias("clicked")).withWatermark("clicked", "2 hours")
    return drained(p.join(c, F.expr("user_id = who and clicked between bought - interval 1 hour and bought")), "append").select("purchase", "click")


def keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, best = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, best = n + len(f), max(best, float(f["value"].max()))
        state.update((n, best))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "best": [best]})

    e = events(spark, sf_dir).select("user_id", "value").groupBy("user_id")
    out = e.applyInPandasWithState(count, "user_id bigint, n bigint, best double", "n bigint, best double", "update", GroupStateTimeout.NoTimeout)
    return drained(out, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max("best").alias("best"))


class Counter(StatefulProcessor):
    """Events of each user so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = (self.n.get()[0] if self.n.exists() else 0) + sum(len(r) for r in rows)
        self.n.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def processor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.newSession()  # the state store is this query's choice alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = events(own, sf_dir).select("user_id", "event_id").groupBy("user_id").transformWithStateInPandas(Counter(), "user_id bigint, n bigint", "Update", "None")
    return drained(out, "update").groupBy("user_id").agg(F.max("n").alias("n"))


class Idle(StatefulProcessor):
    """A user's events, told and forgotten once event time has passed the last one by ``HOURS``."""

    HOURS = 6

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "n bigint, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, until = self.seen.get() if self.seen.exists() else (0, 0)
        if until:
            self.handle.deleteTimer(until)
        for r in rows:
            n, until = n + len(r), max(until, int(r["ms"].max()) + self.HOURS * 3_600_000)
        self.seen.update((n, until))
        self.handle.registerTimer(until)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _ = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def _idle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """What timers have told, and where the state of the others is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events(own, sf_dir).withWatermark("ts", "1 hour").select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    progress = new_path(spark, "progress")
    return drained(rows.groupBy("user_id").transformWithStateInPandas(Idle(), "user_id bigint, n bigint", "Append", "EventTime"), "append", progress), progress


def idle_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who have done nothing for six hours, with the number of their events, told by an event-time timer."""
    return _idle(spark, sf_dir)[0]


def users_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The others: users that are still in the state store when the stream has ended."""
    _, progress = _idle(spark, sf_dir)
    return spark.read.format("statestore").option("stateVarName", "seen").load(progress).select(F.col("key.user_id").alias("user_id"), F.col("value.n").alias("n"))


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink of our own: totals of each micro-batch, under the batch's id, so that a batch run again replaces itself."""
    path = new_path(spark, "totals")

    def save(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = events(spark, sf_dir).writeStream.option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema("event_type string, n bigint, batch int").parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files in turn, the older days last: rows behind the watermark don't count."""
    src = new_path(spark, "late")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    e.where("ts >= timestamp '2024-01-15 00:00:00'").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    n = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    path, progress = new_path(spark, "stream"), new_path(spark, "progress")
    for _ in range(2):
        query = n.writeStream.outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(sink(path)).start()
        query.awaitTermination()
        e.where("ts < timestamp '2024-01-15 00:00:00'").coalesce(1).write.mode("append").parquet(src)
    return collected(spark, path, n.schema).select(F.col("window.start").cast(NTZ).alias("start"), "n")


QUERIES = {
    "s6_file_stream": (file_stream, "select event_id, user_id from events where event_type = 'error'"),
    "t1_tumbling": (_windows("1 day"), "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n from events group by 1, 2"),
    "t2_sliding": (_windows("2 days", "1 day"), "select cast(d as timestamp) as start, event_type, count(*) as n from (select time_bucket(interval 1 day, ts) as d, event_type from events union all select time_bucket(interval 1 day, ts) - interval 1 day, event_type from events) group by 1, 2"),
    "t3_sessions": (sessions, "select user_id, min(ts) as start, count(*) as n from (select user_id, ts, sum(new) over (partition by user_id order by ts) as s from (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events)) group by user_id, s having max(ts) + interval 30 minutes <= (select max(ts) from events) - interval 1 hour"),
    "t4_watermark": (closed_windows, "select time_bucket(interval 1 day, ts) as start, count(*) as n from events group by 1 having time_bucket(interval 1 day, min(ts)) + interval 1 day <= (select max(ts) from events) - interval 1 hour"),
    "t5_dedup": (deduplicated, "select event_id from events"),
    "t5_state_left": (dedup_state, "select event_id from events where ts + interval 2 days > (select max(ts) from events) - interval 2 days"),
    "t7_timers": (idle_users, "select user_id, count(*) as n from events group by 1 having max(ts) + interval 6 hours <= (select max(ts) from events) - interval 1 hour"),
    "t7_state_left": (users_in_state, "select user_id, count(*) as n from events group by 1 having max(ts) + interval 6 hours > (select max(ts) from events) - interval 1 hour"),
    "t6_keyed_state": (keyed_state, "select user_id, count(*) as n, max(value) as best from events group by 1"),
    "t7_processor": (processor_state, "select user_id, count(*) as n from events group by 1"),
    "t8_stream_static": (static_join, "select event_id, c_mktsegment from events join customer on user_id = c_custkey"),
    "t8_stream_stream": (stream_join, "select p.event_id as purchase, c.event_id as click from events p join events c on p.user_id = c.user_id and c.ts between p.ts - interval 1 hour and p.ts where p.event_type = 'purchase' and c.event_type = 'click'"),
    "t10_foreach_batch": (batch_totals, "select event_type, count(*) as n from events group by 1"),
    "t9_late_data": (late_rows, "select time_bucket(interval 1 day, ts) as start, count(*) as n from events where ts >= timestamp '2024-01-15' group by 1 having time_bucket(interval 1 day, min(ts)) + interval 1 day <= (select max(ts) from events) - interval 1 hour"),
}
