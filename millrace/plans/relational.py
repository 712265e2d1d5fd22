"""Projection, filters, aggregation, windows, sorts, sets, subqueries and functions.

An entry is (Spark, DuckDB): Spark is a function of (spark, sf_dir) or SQL over the
tables as views; DuckDB is SQL, or None where the same text does for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import asof_join, range_join, salted_join
from ..operators.search import nearest
from ..operators.selection import percentiles
from ..sources.scratch import new_path
from ..sources.tables import table


def money(c: str, scale: int = 2):
    """Sums of doubles as decimals, so that the order of rows doesn't show."""
    return F.sum(F.col(c).cast(f"decimal(18,{scale})")).cast("double")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), F.count("*").alias("n"))


def broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation has 25 rows at any scale
    return table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey")).select("c_custkey", "n_name")


def _orders_customers(hint: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
        return o.hint(hint).join(c, F.expr("o_custkey = c_custkey")).select("o_orderkey", "c_custkey", "c_mktsegment")

    return run


def _how(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "documents").select("doc_id", "lang")
        lb = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_doc"), "quality")
        return d.join(lb, F.expr("doc_id = label_doc"), how)

    return run


def range_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with all events of the minute after it."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    points = e.select("event_id", at.alias("at"))
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("error"), at.alias("low"), (at + 60_000_000).alias("high"))
    return range_join(points, spans, "at", "low", "high", 60_000_000).select("error", "event_id")


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    c = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return asof_join(p, c, "user_id", "ts", "click", "last_click").select("event_id", "last_click")


def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey")
    return salted_join(li, s, "key").groupBy("s_nationkey").agg(F.count("*").alias("n"), money("l_extendedprice").alias("price"))


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    j = li.join(o, F.expr("l_orderkey = o_orderkey")).join(c, F.expr("o_custkey = c_custkey"))
    revenue = F.sum((F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(22,4)")).cast("double")
    return j.where("o_orderstatus = 'O'").groupBy("c_mktsegment").agg(revenue.alias("revenue"), F.count("*").alias("n"))


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "5-LOW", "low"))
    return o.groupBy("o_orderstatus").pivot("p", ["urgent", "low"]).agg(F.count("o_orderkey")).na.fill(0)


def dearest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two dearest orders of each customer, by a lateral join."""
    # no projection between order and limit: Spark would rank without the order there, and take whatever rows the shuffle brings first
    o = table(spark, sf_dir, "orders").where(F.col("o_custkey") == F.col("c_custkey").outer())
    two = o.orderBy(F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")).limit(2)
    return table(spark, sf_dir, "customer").lateralJoin(two).select("c_custkey", "o_orderkey")


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id", "r")


def vector_top(metric: str):
    """The ten nearest vectors of every twentieth vector, among all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        return nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, metric).withColumn("score", F.round("score", 4))

    return run


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text the document with the least id; only hashes are shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(lb, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


def chats_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of all turns for each conversation, in order; a null role or text is empty."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n").alias("chat"))


def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return o.unpivot("p_partkey", ["size", "price"], "what", "amount")


def set_operation(op: str, a: str, b: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = table(spark, sf_dir, a[0]).select(F.col(a[1]).alias("k"))
        y = table(spark, sf_dir, b[0]).select(F.col(b[1]).alias("k"))
        return getattr(x, op)(y)

    return run


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return a.unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").sample(fraction=0.1, seed=11).select("event_id")


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script over the orders: a variable, a loop that lowers it, and a query with it."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("""
        begin
          declare most bigint;
          declare steps int default 0;
          set most = (select max(n) from (select count(*) as n from orders group by o_custkey));
          while steps < 1 do
            set most = most - 1;
            set steps = steps + 1;
          end while;
          select o_custkey, count(*) as n from orders group by o_custkey having count(*) >= most;
        end""")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr("variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.transform_values(F.create_map(F.lit("key"), F.col("r_regionkey"), F.lit("size"), F.length("r_name")), lambda k, v: v + 1)
    return table(spark, sf_dir, "region").select("r_regionkey", F.map_keys(m)[0].alias("first_key"), m["key"].alias("key"), m["size"].alias("size"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, links and text of pages; scripts, styles and comments are no text."""
    hidden = "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", hidden, " "), "(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
    href = F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), " ")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), href.alias("links"), text.alias("text"))


def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of five words of benchmark items that documents share: exploded, semi-joined, counted."""

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.array_join(F.slice(w, i, 5), " "))
        return F.when(F.size(w) >= 5, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    def grams(name: str, key: str) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
        # the words are a lambda's argument, so that they are made once for a text and not for each run
        return table(spark, sf_dir, name).select(key, F.explode(F.transform(F.array(words), runs)[0]).alias("gram"))

    shared = grams("documents", "doc_id").join(grams("benchmark", "item_id").select("gram").distinct(), "gram", "left_semi")
    return shared.groupBy("doc_id").agg(F.count("*").alias("n"))


def selected_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of prices by return flag, and of all rows as one group."""
    li, f = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), [0.1, 0.5, 0.99]
    whole = percentiles(li, [], "l_extendedprice", f, "price").select(F.lit("all").alias("l_returnflag"), "fraction", "price")
    return percentiles(li, ["l_returnflag"], "l_extendedprice", f, "price").unionAll(whole).withColumn("price", F.round("price", 6))


#: Days of a span, relative error of distinct counts and of ranks that are promised for stored sketches.
SPAN_DAYS, USERS_OFF, RANK_OFF = 7, 0.05, 0.03


def stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each day, written once; every span of seven days from unions of seven of them, held against exact counts."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", "value")
    path = new_path(spark, "sketches")
    e.groupBy("day").agg(F.hll_sketch_agg("user_id", 14).alias("users"), F.kll_sketch_agg_double("value").alias("spread")).write.parquet(path)
    daily = spark.read.schema("day date, users binary, spread binary").parquet(path)
    spans = F.explode(F.sequence("day", F.date_add("day", SPAN_DAYS - 1))).alias("last")
    unions = daily.select(spans, "users", "spread").groupBy("last").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("estimate"), F.kll_merge_agg_double("spread").alias("spread"))
    unions = unions.join(daily.select(F.col("day").alias("last")), "last").select("last", "estimate", F.kll_sketch_get_quantile_double("spread", F.lit(0.5)).alias("middle"))
    # the exact side, which reads the events again
    exact = e.select(spans, "user_id", "value").join(unions, "last").groupBy("last", "estimate", "middle")
    exact = exact.agg(F.count_distinct("user_id").alias("users"), (F.count_if(F.col("value") <= F.col("middle")) / F.count("value")).alias("rank"), F.avg(F.when(F.col("value") == F.col("middle"), 1).otherwise(0)).alias("ties"))
    near = F.abs(F.col("estimate") - F.col("users")) <= USERS_OFF * F.col("users")
    half = (F.col("rank") >= 0.5 - RANK_OFF) & (F.col("rank") - F.col("ties") <= 0.5 + RANK_OFF)
    return exact.select(F.col("last").cast("timestamp_ntz").alias("last"), "users", near.alias("users_near"), half.alias("middle_near"))


def approx_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number of users beside the estimate, which is to be within three times its error of 0.01."""
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.01).alias("estimate"))
    return n.select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.ceil(0.03 * F.col("users"))).alias("close"))


TS = "cast({} as timestamp_ntz)"
_W = "over (partition by user_id order by ts, event_id)"

QUERIES = {
    "pricing_summary": (pricing_summary, "select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) sum_qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) sum_price, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by 1, 2"),
    "s1_scan": (lambda s, d: table(s, d, "part"), "select * from part"),
    "f1_projection": ("select l_orderkey, l_linenumber, l_partkey, l_quantity * l_discount as off from lineitem", None),
    "f2_filters": ("select l_orderkey, l_linenumber from lineitem where l_discount between 0.05 and 0.07 and not (l_returnflag in ('A', 'N') or l_quantity >= 24) and l_tax is not null", None),
    "f2_like": ("select p_partkey, p_name from part where p_type like 'ECO%' or p_brand in ('Brand#11', 'Brand#22')", None),
    "f3_case": ("select o_orderkey, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band, coalesce(nullif(o_orderstatus, 'P'), '?') as status from orders", None),
    "f4_distinct": (lambda s, d: table(s, d, "documents").select("lang", "source").distinct(), "select distinct lang, source from documents"),
    "f4_drop_duplicates": (lambda s, d: table(s, d, "orders").dropDuplicates(["o_custkey", "o_orderstatus"]).select("o_custkey", "o_orderstatus"), "select distinct o_custkey, o_orderstatus from orders"),
    "f5_sample": (sampled, None),
    "f5_hash_sample": ("select event_id from events where md5(cast(event_id as string)) < '19999999'", "select event_id from events where md5(cast(event_id as varchar)) < '19999999'"),
    "j1_broadcast": (broadcast_join, "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey"),
    "j2_merge": (_orders_customers("merge"), "select o_orderkey, c_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey"),
    "j3_hash": (_orders_customers("shuffle_hash"), "select o_orderkey, c_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey"),
    **{f"j4_{h}": (_how(h), f"select doc_id, lang, label_doc, quality from documents {h} join (select doc_id as label_doc, quality from labels) l on doc_id = label_doc") for h in ("left", "right", "full")},
    "j5_semi": ("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)", None),
    "j6_anti": ("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)", None),
    # at most 25 nations are in the subquery, whatever the customers
    "j6_not_in": ("select s_suppkey from supplier where s_nationkey not in (select distinct c_nationkey from customer where c_acctbal > 9500)", None),
    "j7_cross": (lambda s, d: table(s, d, "region").crossJoin(table(s, d, "nation")).select("r_regionkey", "n_nationkey"), "select r_regionkey, n_nationkey from region, nation"),
    "j8_theta": ("select r_regionkey, n_nationkey from region join nation on r_regionkey < n_regionkey", None),
    "j9_range": (range_bins, "select e.event_id as error, o.event_id from events e join events o on epoch_us(o.ts) between epoch_us(e.ts) and epoch_us(e.ts) + 60000000 where e.event_type = 'error'"),
    "j10_asof": (asof, "select p.event_id, c.event_id as last_click from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts >= c.ts"),
    "j11_lateral": (dearest_orders, "select c_custkey, o_orderkey from customer, lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 2)"),
    "j12_star": (star, "select c_mktsegment, cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as revenue, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where o_orderstatus = 'O' group by 1"),
    "j13_salted": (salted, "select s_nationkey, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price from lineitem join supplier on l_suppkey = s_suppkey group by 1"),
    "a1_group": ("select l_returnflag, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty, count(*) as n, min(l_shipdate) as first_ship, max(l_tax) as max_tax, round(avg(l_discount), 6) as avg_discount from lineitem group by l_returnflag", None),
    "a2_global": ("select count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high, round(avg(o_totalprice), 4) as mean from orders", None),
    "a3_count_distinct": ("select event_type, count(distinct user_id) as users from events group by event_type", None),
    "a4_approx_distinct": (approx_users, "select event_type, count(distinct user_id) as users, true as close from events group by 1"),
    "a5_moments": ("select p_brand, round(stddev(p_retailprice), 6) as sd, round(variance(p_retailprice), 6) as var from part group by p_brand", None),
    "a5_corr": ("select round(corr(l_quantity, l_extendedprice), 6) as r from lineitem", None),
    "a4_stored_sketches": (stored_sketches, "with d as (select distinct cast(cast(ts as date) as timestamp) as last from events) select last, count(distinct user_id) as users, true as users_near, true as middle_near from d join events on ts >= last - interval 6 days and ts < last + interval 1 day group by last"),
    "a6_selection": (selected_percentiles, " union all ".join(f"select {g} as l_returnflag, cast({f} as double) as fraction, round(quantile_cont(l_extendedprice, {f}), 6) as price from lineitem group by 1" for g in ("l_returnflag", "'all'") for f in (0.1, 0.5, 0.99))),
    "a6_percentiles": ("select p_type, median(p_retailprice) as med, percentile_cont(0.9) within group (order by p_retailprice) as p90 from part group by p_type", None),
    "a7_max_by": ("select user_id, max_by(event_id, value) as best, min_by(event_id, value) as worst from (select user_id, min(event_id) as event_id, value from events group by user_id, value) e group by user_id", None),
    "a7_mode": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("usual")), "select user_id, event_type as usual from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as r from events group by user_id, event_type) where r = 1"),
    "a8_string_agg": ("select n_regionkey, array_join(array_sort(collect_list(n_name)), ',') as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1"),
    "a9_filter": ("select user_id, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where value > 50) as large from events group by user_id", None),
    "a10_grouping_sets": ("select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())", None),
    "a11_cube": (lambda s, d: table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)"),
    "a12_rollup": (lambda s, d: table(s, d, "nation").rollup("n_regionkey", "n_name").agg(F.count("*").alias("n"), F.grouping("n_name").cast("bigint").alias("g")), "select n_regionkey, n_name, count(*) as n, grouping(n_name) as g from nation group by rollup (n_regionkey, n_name)"),
    "a13_pivot": (pivot, "select o_orderstatus, count(*) filter (where o_orderpriority = '1-URGENT') as urgent, count(*) filter (where o_orderpriority = '5-LOW') as low from orders group by 1"),
    "a14_unpivot": (unpivoted, "select p_partkey, 'size' as what, cast(p_size as double) as amount from part union all select p_partkey, 'price', p_retailprice from part"),
    "a15_having": ("select user_id, count(*) as n from events group by user_id having count(*) > 5", None),
    "w1_ranks": (f"select event_id, cast(row_number() {_W} as bigint) as rn, cast(rank() over (partition by user_id order by event_type) as bigint) as rk, cast(dense_rank() over (partition by user_id order by event_type) as bigint) as dr, round(percent_rank() {_W}, 6) as pr, round(cume_dist() {_W}, 6) as cd from events", None),
    "w2_ntile": ("select n_nationkey, cast(ntile(4) over (partition by n_regionkey order by n_nationkey) as bigint) as t from nation", None),
    "w3_lag_lead": (f"select event_id, lag(event_id) {_W} as before, lead(event_id, 2, -1) {_W} as after, nth_value(event_id, 2) {_W} as second from events", None),
    "w4_first_last": ("select event_id, first_value(event_id) over w as f, last_value(event_id) over w as l from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and 1 following)", None),
    "w5_ignore_nulls": (f"select event_id, lag(case when event_type = 'click' then event_id end) ignore nulls {_W} as last_click from events", f"select event_id, lag(case when event_type = 'click' then event_id end ignore nulls) {_W} as last_click from events"),
    "w6_rows_frame": ("select event_id, cast(sum(cast(value as decimal(18,2))) over (partition by user_id order by ts, event_id rows between 3 preceding and current row) as double) as s from events", None),
    "w7_range_frame": ("select event_id, count(*) over (partition by user_id order by event_id range between 50 preceding and 50 following) as n from events", None),
    "w8_interval_frame": ("select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as n from events", None),
    "w9_top_per_group": (top_per_group, "select user_id, event_id, cast(row_number() over (partition by user_id order by value desc, event_id) as integer) as r from events qualify r <= 3"),
    "l1_order_nulls": ("select o_orderkey, nullif(o_orderstatus, 'P') as s from orders order by s asc nulls last, o_orderkey desc", None),
    "l2_top_k": (lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20"),
    "l3_offset": (lambda s, d: table(s, d, "customer").orderBy("c_custkey").offset(20).limit(30).select("c_custkey"), "select c_custkey from customer order by c_custkey limit 30 offset 20"),
    "u1_union_distinct": ("select n_regionkey as k from nation union select r_regionkey from region", None),
    "u1_except": (set_operation("subtract", ("nation", "n_nationkey"), ("region", "r_regionkey")), "select n_nationkey as k from nation except select r_regionkey from region"),
    "u2_union_all": ("select n_regionkey as k from nation union all select r_regionkey from region", None),
    "u2_union_by_name": (union_by_name, "select n_name as name, n_nationkey as key from nation union all by name select r_regionkey as key, r_name as name from region"),
    "u3_intersect_all": (set_operation("intersectAll", ("customer", "c_nationkey"), ("supplier", "s_nationkey")), "select c_nationkey as k from customer intersect all select s_nationkey from supplier"),
    "u4_intersect": (set_operation("intersect", ("customer", "c_nationkey"), ("region", "r_regionkey")), "select c_nationkey as k from customer intersect select r_regionkey from region"),
    "u4_except_all": (set_operation("exceptAll", ("customer", "c_nationkey"), ("supplier", "s_nationkey")), "select c_nationkey as k from customer except all select s_nationkey from supplier"),
    "q1_correlated": ("select o_orderkey, (select max(l_extendedprice) from lineitem where l_orderkey = o_orderkey) as dearest from orders", None),
    "q2_recursive": ("with recursive r(conv_id, turn, chars) as (select conv_id, turn, cast(length(text) as bigint) from conversations where turn = 0 union all select c.conv_id, c.turn, r.chars + cast(length(c.text) as bigint) from r join conversations c on c.conv_id = r.conv_id and c.turn = r.turn + 1) select conv_id, turn, chars from r", None),
    "q3_scripting": (scripted, "with c as (select o_custkey, count(*) as n from orders group by 1) select o_custkey, n from c where n >= (select max(n) from c) - 1"),
    "x1_strings": ("select p_partkey, cast(length(p_name) as bigint) as len, upper(p_name) as up, lpad(p_brand, 12, '*') as pad, replace(p_type, 'A', 'a') as rep, trim('  x ') as t, substring(p_name, 2, 3) as sub, cast(levenshtein(p_name, p_type) as bigint) as lev, md5(p_name) as md, split(p_name, ' ')[0] as first_word, concat(p_brand, '/', p_type) as both from part", "select p_partkey, length(p_name) as len, upper(p_name) as up, lpad(p_brand, 12, '*') as pad, replace(p_type, 'A', 'a') as rep, trim('  x ') as t, substring(p_name, 2, 3) as sub, levenshtein(p_name, p_type) as lev, md5(p_name) as md, split_part(p_name, ' ', 1) as first_word, concat(p_brand, '/', p_type) as both from part"),
    "x2_regex": (r"select doc_id, regexp_replace(text, '[aeiou]', '*') as masked, regexp_extract(text, '[A-Z][a-z]+', 0) as name from documents", r"select doc_id, regexp_replace(text, '[aeiou]', '*', 'g') as masked, regexp_extract(text, '[A-Z][a-z]+') as name from documents"),
    "x3_dates": ("select o_orderkey, cast(date_trunc('month', o_orderdate) as timestamp_ntz) as m, cast(extract(year from o_orderdate) as bigint) as y, cast(o_orderdate as date) as d, o_orderdate + interval 3 days as later, cast(datediff(date '2002-01-01', cast(o_orderdate as date)) as bigint) as days from orders", "select o_orderkey, cast(date_trunc('month', o_orderdate) as timestamp) as m, extract(year from o_orderdate) as y, cast(o_orderdate as date) as d, o_orderdate + interval 3 days as later, datediff('day', cast(o_orderdate as date), date '2002-01-01') as days from orders"),
    "x4_math": ("select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_discount, 6) as r, l_orderkey % 7 as m, l_orderkey div 7 as q, greatest(l_tax, l_discount) as g, abs(l_quantity - 25) as a, floor(l_quantity / 3) as f, round(sqrt(l_quantity), 6) as s from lineitem", "select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_discount, 6) as r, l_orderkey % 7 as m, l_orderkey // 7 as q, greatest(l_tax, l_discount) as g, abs(l_quantity - 25) as a, cast(floor(l_quantity / 3) as bigint) as f, round(sqrt(l_quantity), 6) as s from lineitem"),
    "x5_arrays": ("select vec_id, size(embedding) as n, cast(array_max(embedding) as double) as top, cast(element_at(array_sort(embedding), 3) as double) as third from embeddings", "select vec_id, cast(len(embedding) as integer) as n, cast(list_max(embedding) as double) as top, cast(list_sort(embedding)[3] as double) as third from embeddings"),
    "x5_explode": ("select vec_id, cast(pos + 1 as bigint) as place, cast(x as double) as x from embeddings lateral view posexplode(embedding) t as pos, x", "select vec_id, i as place, cast(embedding[i] as double) as x from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)"),
    "x6_maps": (maps, "select r_regionkey, 'key' as first_key, r_regionkey + 1 as key, cast(length(r_name) + 1 as integer) as size from region"),
    "x7_json": ("select event_id, cast(get_json_object(props, '$.k') as bigint) as k from events", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events"),
    "x8_variant": (variants, "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events"),
    "x9_hash": ("select doc_id, sha2(text, 256) as h, md5(text) as m, sha1(text) as s from documents", "select doc_id, sha256(text) as h, md5(text) as m, sha1(text) as s from documents"),
    "x9_checksums": (lambda s, d: table(s, d, "documents").select("doc_id", F.xxhash64("text").alias("xx"), F.crc32("text").alias("crc")), None),
    **{name: (vector_top(metric), f"""select query, cast(rank as integer) as rank, id, round(score, 4) as score from (select q.vec_id as query, e.vec_id as id, {call}(q.embedding::double[], e.embedding::double[]) as score,
        row_number() over (partition by q.vec_id order by round({call}(q.embedding::double[], e.embedding::double[]), 9) desc, e.vec_id) as rank from embeddings q join embeddings e on q.vec_id % 20 = 0 and e.vec_id <> q.vec_id) where rank <= 10""")
        for name, metric, call in (("v1_vector_top", "dot", "list_dot_product"), ("v1_cosine", "cosine", "list_cosine_similarity"))},
    "v2_exact_dedup": (exact_duplicates, "select min(doc_id) as doc_id, count(*) as copies from documents group by text"),
    "v4_shared_words": (leaked_items, "with w as (select 0 as side, item_id as id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as w from benchmark union all select 1, doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') from documents), g as (select distinct side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as gram from w where len(w) >= 5) select id as doc_id, count(*) as n from g where side = 1 and gram in (select gram from g where side = 0) group by 1"),
    "v5_links": (links, r"""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') as links,
        trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as text from pages"""),
    "v6_source_quality": (source_quality, "select source, count(*) as n, cast(sum(quality) as bigint) as good from documents join labels using (doc_id) group by 1"),
    "v7_conversations": (chats_assembled, "select conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) order by turn nulls first, role nulls first, text nulls first) as chat from conversations group by 1"),
}
