"""User functions of every kind: scalar, Arrow, pandas, grouped, cogrouped, table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    shout = F.udf(lambda s: None if s is None else s.lower().capitalize(), "string")
    return table(spark, sf_dir, "region").select("r_regionkey", shout("r_name").alias("name"))


def arrow_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.udf(lambda s: None if s is None else len(s), "bigint", useArrow=True)
    return table(spark, sf_dir, "nation").select("n_nationkey", size("n_name").alias("n"))


def pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def half(v: pd.Series) -> pd.Series:
        return v / 2

    return table(spark, sf_dir, "orders").select("o_orderkey", half("o_totalprice").alias("half_price"))


def pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(spread("o_totalprice").alias("spread"))


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Letters:
        def eval(self, key: int, text: str):
            for i, c in enumerate(text or ""):
                yield key, i + 1, c

    spark.udtf.register("letters", F.udtf(Letters, returnType="key int, place int, letter string"))
    table(spark, sf_dir, "region").createOrReplaceTempView("region")
    return spark.sql("select t.* from region, lateral letters(r_regionkey, r_name) t")


def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[b["value"] > 100][["event_id", "value"]]

    return table(spark, sf_dir, "events").select("event_id", "value").mapInPandas(run, "event_id bigint, value double")


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    def top(g: pd.DataFrame) -> pd.DataFrame:
        return g.nlargest(1, "event_id")

    return table(spark, sf_dir, "events").select("user_id", "event_id").groupBy("user_id").applyInPandas(top, "user_id bigint, event_id bigint")


def cogrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"custkey": [key[0]], "customers": [len(a)], "orders": [len(b)]})

    c = table(spark, sf_dir, "customer").select("c_custkey").groupBy("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey").groupBy("o_custkey")
    return c.cogroup(o).applyInPandas(both, "custkey bigint, customers bigint, orders bigint")


QUERIES = {
    "g1_scalar_udf": (scalar_udf, "select r_regionkey, upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) as name from region"),
    "g1_arrow_udf": (arrow_udf, "select n_nationkey, length(n_name) as n from nation"),
    "g2_pandas_udf": (pandas_scalar, "select o_orderkey, o_totalprice / 2 as half_price from orders"),
    "g2_pandas_udaf": (pandas_aggregate, "select o_custkey, max(o_totalprice) - min(o_totalprice) as spread from orders group by 1"),
    "g3_udtf": (table_function, "select r_regionkey as key, cast(i as integer) as place, substr(r_name, cast(i as integer), 1) as letter from region, range(1, 100) t(i) where i <= length(r_name)"),
    "g4_map_in_pandas": (map_batches, "select event_id, value from events where value > 100"),
    "g4_apply_in_pandas": (grouped, "select user_id, max(event_id) as event_id from events group by 1"),
    "g4_cogroup": (cogrouped, "select n as custkey, count(c) as customers, count(o) as orders from (select c_custkey n, 1 c, null o from customer union all select o_custkey, null, 1 from orders) group by 1"),
}
