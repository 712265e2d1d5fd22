"""Round trips through Spark's file formats, and a batch source of our own."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import new_path
from .tables import table


def parquet_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrites twice and appends once: the last overwrite and the append remain."""
    path, nation = new_path(spark, "modes"), table(spark, sf_dir, "nation")
    for mode in ("overwrite", "overwrite", "append"):
        nation.write.mode(mode).parquet(path)
    return spark.read.parquet(path)


def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = table(spark, sf_dir, "supplier"), new_path(spark, "csv")
    df.write.option("header", True).csv(path)
    return spark.read.schema(df.schema).option("header", True).csv(path)


def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = table(spark, sf_dir, "nation"), new_path(spark, "json")
    df.write.json(path)
    return spark.read.schema(df.schema).json(path)


def orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = table(spark, sf_dir, "customer"), new_path(spark, "orc")
    df.write.orc(path)
    return spark.read.schema(df.schema).orc(path).where("c_acctbal > 9000")


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "text")
    table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("r_name"))


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by status, rows of a frequent one by several tasks; the filter on it prunes folders."""
    path = new_path(spark, "partitioned")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    orders.hint("rebalance", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema(orders.schema).parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")


class Calendar(DataSource):
    """Days from option ``first`` to option ``last`` (ISO), with their week, in partitions of ``STEP`` days."""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date, week int"

    def reader(self, schema) -> DataSourceReader:
        return CalendarReader(date.fromisoformat(self.options["first"]), date.fromisoformat(self.options["last"]))


class CalendarReader(DataSourceReader):
    STEP = 366

    def __init__(self, first: date, last: date):
        self.first, self.last = first.toordinal(), last.toordinal()

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(a) for a in range(self.first, self.last + 1, self.STEP)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n in range(partition.value, min(partition.value + self.STEP, self.last + 1)):
            day = date.fromordinal(n)
            yield day, day.isocalendar().week


def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every day of the table's span, from a source of days; days without any count 0."""
    spark.dataSource.register(Calendar)
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    first, last = o.agg(F.min("day"), F.max("day")).first()
    days = spark.read.format("calendar").option("first", str(first)).option("last", str(last)).load()
    return days.join(o.groupBy("day").agg(F.count("*").alias("n")), "day", "left").select(F.col("day").cast("timestamp_ntz").alias("day"), "week", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


QUERIES = {
    "s2_parquet_modes": (parquet_modes, "select * from nation union all select * from nation"),
    "s3_csv": (csv, "select * from supplier"),
    "s3_json": (json, "select * from nation"),
    "s3_orc": (orc, "select * from customer where c_acctbal > 9000"),
    "s3_text": (text, "select r_name from region"),
    "s4_partitioned_write": (partitioned, "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus = 'F'"),
    "s5_custom_source": (custom, "with o as (select cast(o_orderdate as date) as day, count(*) as n from orders group by 1), d as (select unnest(generate_series((select min(day) from o), (select max(day) from o), interval 1 day)) as day) select cast(d.day as timestamp) as day, cast(weekofyear(d.day) as integer) as week, coalesce(n, 0) as n from d left join o on o.day = d.day"),
}
