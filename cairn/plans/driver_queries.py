"""Queries over the driver's tables, each with the SQL that must give the same rows.

Every query runs over its whole tables. ``limit`` appears only where a limit is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import arrays as A
from cairn.functions import codecs as C
from cairn.functions import reducer as R
from cairn.operators import ranges as G
from cairn.operators import relation as L
from cairn.operators import windows as W
from cairn.operators.mapping import Mapping, cogroup
from cairn.operators.series import Series
from cairn.streaming import apps
from cairn.streaming.changelog import group_updates, running_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions, so that costly work on each row doesn't wait for a few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf: str, item: str = "event_type") -> Series:
    return Series.of(read(spark, sf, "events"), item, "event_id")


# -- projection, restriction, flattening ------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def map_revenue(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_extendedprice", "l_discount").alias("revenue"))
    return Series(df, "revenue", "l_orderkey").map(lambda x: x["l_extendedprice"] * (1 - x["l_discount"])).df


@query("SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_quantity > 20")
def filter_ship(spark, sf):
    s = Series(read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity"), "l_shipdate", "l_orderkey")
    return s.filter(lambda x: x < F.lit("1998-01-01").cast("timestamp")).filter(lambda x: F.col("l_quantity") > 20).df


@query("SELECT l_orderkey, l_returnflag FROM lineitem WHERE NOT (l_returnflag = 'R')")
def remove_returned(spark, sf):
    s = Series(read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), "l_returnflag", "l_orderkey")
    return s.remove(lambda x: x == "R").df


@query("SELECT l_orderkey, CASE WHEN l_discount > 0.05 THEN l_extendedprice END AS price FROM lineitem WHERE l_discount > 0.05")
def filter_map_discount(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", F.struct("l_discount", "l_extendedprice").alias("price"))
    return Series(df, "price", "l_orderkey").filter_map(lambda x: F.when(x["l_discount"] > 0.05, x["l_extendedprice"])).df


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM documents) GROUP BY w")
def flat_map_words(spark, sf):
    words = Series.of(read(spark, sf, "documents"), "text", "doc_id").flat_map(A.string_words)
    return words.group(lambda x: x, lambda x: x, R.count(), ("word", "n")).pairs()


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS piece FROM part")
def unnest_words(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", "p_name")
    s = Series(df.withColumn("_pos", F.col("p_partkey")), "p_name", "_pos").unnest(lambda x: A.string_split(x, " "))
    return s.df.select("p_partkey", F.col("p_name").alias("piece"))


@query("SELECT p_partkey, len(string_split(p_name, ' ')) AS pieces, string_split(p_name, ' ')[1] AS head FROM part")
def string_split_p_name(spark, sf):
    parts = A.string_split(F.col("p_name"), " ")
    return read(spark, sf, "part").select("p_partkey", F.size(parts).cast("long").alias("pieces"), F.get(parts, F.lit(0)).alias("head"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z]+')) AS words FROM documents")
def string_extract_words(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(A.string_words(F.col("text"))).cast("long").alias("words"))


@query("SELECT o_orderkey, len(list_filter([1,2,3,4], lambda x: x <= o_orderkey % 5)) AS kept FROM orders")
def nested_filter(spark, sf):
    from cairn.lang.builtins import filter_

    xs = filter_(lambda x: x <= F.col("o_orderkey") % 5, F.array(*map(F.lit, (1, 2, 3, 4))))
    return read(spark, sf, "orders").select("o_orderkey", F.size(xs).cast("long").alias("kept"))


# -- prefixes, positions, neighbours --------------------------------------------------------------


@query("SELECT o_orderkey AS pos, o_orderpriority AS item FROM orders ORDER BY o_orderkey LIMIT 100")
def take_orders(spark, sf):
    s = Series.of(read(spark, sf, "orders"), "o_orderpriority", "o_orderkey").take(100)
    return s.df.select(F.col("_pos").alias("pos"), "item")


@query("SELECT o_orderkey AS pos, o_orderpriority AS item FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n > 100")
def drop_orders(spark, sf):
    s = Series.of(read(spark, sf, "orders"), "o_orderpriority", "o_orderkey").drop(100)
    return s.df.select(F.col("_pos").alias("pos"), "item")


_STOP = "(SELECT min(event_id) FROM events WHERE NOT value < 150)"


@query(f"SELECT event_id AS pos, value AS item FROM events WHERE event_id < coalesce({_STOP}, 9223372036854775807)")
def take_while_value(spark, sf):
    s = events(spark, sf, "value").take_while(lambda x: x < 150)
    return s.df.select(F.col("_pos").alias("pos"), "item")


@query(f"SELECT event_id AS pos, value AS item FROM events WHERE event_id >= {_STOP}")
def drop_while_value(spark, sf):
    s = events(spark, sf, "value").drop_while(lambda x: x < 150)
    return s.df.select(F.col("_pos").alias("pos"), "item")


@query("SELECT event_type AS item FROM events ORDER BY event_id LIMIT 1")
def take_first_event(spark, sf):
    return events(spark, sf).take_first().df.select("item")


@query("SELECT event_type AS item FROM events ORDER BY event_id DESC LIMIT 1")
def take_last_event(spark, sf):
    return events(spark, sf).take_last().df.select("item")


@query("SELECT event_id AS pos, sum(user_id) OVER (ORDER BY event_id)::BIGINT AS rolled FROM events")
def rolling_sum(spark, sf):
    s = events(spark, sf, "user_id").rolling_sum()
    return s.df.select(F.col("_pos").alias("pos"), F.col("rolled").cast("long").alias("rolled"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS high FROM events")
def rolling_max_by_user(spark, sf):
    df = read(spark, sf, "events").select("event_id", "user_id", "value")
    return Series(df, "value", "event_id").rolling(F.max, "high", ["user_id"]).df.select("event_id", "high")


@query("SELECT event_id AS pos, event_type AS item FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def dedupe_event_type(spark, sf):
    return events(spark, sf).dedupe().df.select(F.col("_pos").alias("pos"), "item")


@query("SELECT min(event_id) AS pos, event_type AS item FROM events GROUP BY event_type")
def unique_event_type(spark, sf):
    return events(spark, sf).unique().df.select(F.col("_pos").alias("pos"), "item")


@query("SELECT item, count(*) AS n FROM (SELECT event_type AS item FROM events UNION ALL SELECT '|' FROM (SELECT event_id FROM events ORDER BY event_id OFFSET 1)) GROUP BY item")
def interpose_types(spark, sf):
    return events(spark, sf).interpose(F.lit("|")).df.groupBy("item").agg(F.count("*").alias("n"))


@query("SELECT event_id AS pos, 0 AS place, '<' AS item FROM events UNION ALL SELECT event_id, 1, event_type FROM events")
def before_each(spark, sf):
    return events(spark, sf).before_each(F.lit("<")).df.select(F.col("_pos._outer").alias("pos"), F.col("_pos._inner").alias("place"), "item")


@query("SELECT event_id AS pos, 0 AS place, event_type AS item FROM events UNION ALL SELECT event_id, 1, '>' FROM events")
def after_each(spark, sf):
    return events(spark, sf).after_each(F.lit(">")).df.select(F.col("_pos._outer").alias("pos"), F.col("_pos._inner").alias("place"), "item")


@query("SELECT 0 AS part, NULL::BIGINT AS pos, 'begin' AS item UNION ALL SELECT 1, event_id, event_type FROM events UNION ALL SELECT 2, NULL, 'end'")
def decorate_types(spark, sf):
    return events(spark, sf).decorate(F.lit("begin"), F.lit("end")).df.select(F.col("_pos._k").alias("part"), F.col("_pos._p").alias("pos"), "item")


@query("SELECT NOT EXISTS (SELECT 1 FROM (SELECT row_number() OVER (ORDER BY event_id) n, event_type x FROM events) a FULL JOIN (SELECT row_number() OVER (ORDER BY event_id) n, event_type x FROM events WHERE event_id > 0) b USING (n) WHERE a.x IS DISTINCT FROM b.x) AS equal")
def series_equal(spark, sf):
    a = events(spark, sf)
    return a.equal(Series(a.df.where("_pos > 0"), "item"))


@query("SELECT event_id AS pos, array_to_string(list_value(lag(event_type, 2) OVER w, lag(event_type) OVER w, event_type), ',') AS joined FROM events WINDOW w AS (ORDER BY event_id) QUALIFY row_number() OVER w >= 3")
def window_of_3(spark, sf):
    s = events(spark, sf).windows_of(3)
    return s.df.select(F.col("_pos").alias("pos"), F.array_join("window", ",").alias("joined"))


# -- top-k -------------------------------------------------------------------------------------------


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 10")
def top_words(spark, sf):
    counts = flat_map_words(spark, sf)
    s = Series(counts.select(F.col("word").alias("_pos"), F.struct("word", "n").alias("item")), "item")
    return s.top(lambda x: x["word"], lambda x: x["n"], 10).select("item.*")


@query("""SELECT o_custkey AS cust, value FROM (SELECT o_custkey, o_orderkey, o_totalprice AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
WHERE rn = 1 ORDER BY value DESC, o_orderkey LIMIT 20""")
def top_keyed_customer(spark, sf):
    s = Series(read(spark, sf, "orders").select(F.col("o_orderkey").alias("_pos"), F.struct("o_custkey", "o_totalprice").alias("item")), "item")
    return s.top(lambda x: x["o_custkey"], lambda x: x["o_totalprice"], 20).select(F.col("item.o_custkey").alias("cust"), "value")


# -- generators ---------------------------------------------------------------------------------------


@query("SELECT range AS pos, range AS item FROM range(1, 1001)")
def range_iter(spark, sf):
    return Series.range(spark, 1, 1000).df.select(F.col("_pos").alias("pos"), "item")


@query("SELECT range AS pos, 5 AS item FROM range(0, 30)")
def repeat_iter(spark, sf):
    return Series.repeat(spark, 30, F.lit(5)).df.select(F.col("_pos").alias("pos"), "item")


@query("SELECT range AS pos, range * 9 AS item FROM range(0, 10)")
def iterate_arith(spark, sf):
    return Series.iterate(spark, 10, lambda x: x + 9, F.lit(0).cast("long")).df.select(F.col("_pos").alias("pos"), "item")


@query("SELECT o_orderkey, CASE WHEN 3 > o_orderkey % 7 THEN 0 ELSE o_orderkey % 7 - 2 END AS n FROM orders")
def range_guard(spark, sf):
    xs = A.range_(F.lit(3).cast("long"), F.col("o_orderkey") % 7)
    return read(spark, sf, "orders").select("o_orderkey", F.size(xs).cast("long").alias("n"))


# -- reducers -----------------------------------------------------------------------------------------


@query("SELECT coalesce(sum(o_custkey), 0)::BIGINT AS total FROM orders")
def reduce_sum(spark, sf):
    return Series.of(read(spark, sf, "orders"), "o_custkey", "o_orderkey").reduce(R.sum_(), "total")


@query("SELECT sum(l_linenumber)::BIGINT AS a, count(*) AS b FROM lineitem")
def reduce_product_reducer(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("_pos"), F.struct(F.col("l_linenumber").cast("long").alias("_1"), F.col("l_partkey").alias("_2")).alias("item"))
    return Series(df, "item").reduce(R.product(R.sum_(), R.count())).select(F.col("result._1").alias("a"), F.col("result._2").alias("b"))


@query("SELECT bool_and(l_quantity > 0) AS forall, bool_or(l_discount > 0.09) AS exists FROM lineitem")
def forall_exists(spark, sf):
    df = read(spark, sf, "lineitem")
    return df.agg(R.and_().over_rows(F.col("l_quantity") > 0, F.lit(0)).alias("forall"), R.or_().over_rows(F.col("l_discount") > 0.09, F.lit(0)).alias("exists"))


@query("SELECT true AS forall, false AS exists, true AS is_empty, 0::BIGINT AS total")
def empty_zeros(spark, sf):
    s = Series.of(read(spark, sf, "orders").where("o_orderkey < 0"), "o_custkey", "o_orderkey")
    f = s.forall(lambda x: x > 0).crossJoin(s.exists(lambda x: x > 0)).crossJoin(s.is_empty())  # one row each
    return f.crossJoin(s.reduce(R.sum_(), "total"))


@query("SELECT arg_min(o_orderpriority, o_orderkey) AS first, arg_max(o_orderpriority, o_orderkey) AS last, 'none' AS missing FROM orders")
def first_or_last_or(spark, sf):
    df = read(spark, sf, "orders")
    x, p = F.col("o_orderpriority"), F.col("o_orderkey")
    missing = R.first_or(F.lit("none")).over_rows(F.when(F.lit(False), x), p)
    return df.agg(R.first_or(F.lit("none")).over_rows(x, p).alias("first"), R.last_or(F.lit("none")).over_rows(x, p).alias("last"), missing.alias("missing"))


@query("SELECT count(*) AS length FROM lineitem")
def length(spark, sf):
    return Series(read(spark, sf, "lineitem"), "l_quantity", "l_orderkey").length()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_count(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("_pos"), F.struct("l_returnflag", "l_linestatus").alias("item"))
    return Series(df, "item").group(lambda x: x, lambda x: x["l_linestatus"], R.count(), ("key", "n")).pairs().select("key.*", "n")


@query("SELECT o_custkey AS key, sum(o_orderkey)::BIGINT AS value FROM orders GROUP BY 1")
def group_sum(spark, sf):
    s = Series(read(spark, sf, "orders").select(F.col("o_orderkey").alias("_pos"), F.struct("o_custkey", "o_orderkey").alias("item")), "item")
    return s.group(lambda x: x["o_custkey"], lambda x: x["o_orderkey"], R.sum_()).pairs()


@query("SELECT o_custkey AS key, count(*) AS value FROM orders GROUP BY 1")
def group_bag_len(spark, sf):
    s = Series(read(spark, sf, "orders").select(F.col("o_orderkey").alias("_pos"), F.struct("o_custkey", "o_orderkey").alias("item")), "item")
    return s.group(lambda x: x["o_custkey"], lambda x: x["o_orderkey"], R.bag().project(lambda xs: F.size(xs).cast("long"))).pairs()


@query("SELECT user_id AS key, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS value FROM events GROUP BY 1")
def group_set(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(R.set_().project(lambda xs: F.array_join(xs, ",")).over_rows(F.col("event_type"), F.col("event_id")).alias("value"))


@query("SELECT o_orderkey % 3 AS key, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1")
def partition_by_mod(spark, sf):
    parts = Series.of(read(spark, sf, "orders"), "o_orderkey", "o_orderkey").partition(lambda x: x % 3)
    ends = parts.project(lambda xs: F.struct(F.size(xs).cast("long").alias("n"), F.array_min(xs).alias("low"), F.array_max(xs).alias("high")))
    return ends.pairs().select("key", "value.*")


@query("SELECT count(*) >= 100 AS at_least FROM (SELECT 1 FROM orders LIMIT 100)")
def at_least_n(spark, sf):
    return Series(read(spark, sf, "orders"), "o_orderkey", "o_orderkey").at_least(100)


@query("SELECT user_id, max(n) AS most, count(*) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def nested_group(spark, sf):
    df = read(spark, sf, "events").select(F.col("event_id").alias("_pos"), F.struct("user_id", "event_type").alias("item"))
    kinds = Series(df, "item").group(lambda x: x["user_id"], lambda x: x["event_type"], R.group(lambda t: t, lambda t: t, R.count()), ("user_id", "by"))
    return kinds.pairs().select("user_id", F.array_max(F.map_values("by")).alias("most"), F.size("by").cast("long").alias("kinds"))


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS joined FROM events GROUP BY 1")
def string_reducer(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(R.text().over_rows(F.col("event_type"), F.col("event_id")).alias("joined"))


@query("SELECT user_id, sum(CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END)::BIGINT AS total FROM events GROUP BY 1")
def filtering_reducer(spark, sf):
    r = R.sum_().filtering(lambda x: x % 2 == 0)
    return read(spark, sf, "events").groupBy("user_id").agg(r.over_rows(F.col("event_id"), F.col("event_id")).alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE (o_orderkey % 4) ** 3 END::BIGINT AS cube, 8::BIGINT AS subsets FROM orders")
def power_and_subsets(spark, sf):
    k = F.col("o_orderkey") % 4
    cube = F.when(k == 0, F.lit(1)).otherwise(A.power(k, F.lit(3)))
    return read(spark, sf, "orders").select("o_orderkey", cube.cast("long").alias("cube"), F.size(A.power_set(F.array(F.lit(1), F.lit(2), F.lit(3)))).cast("long").alias("subsets"))


# -- windows ------------------------------------------------------------------------------------------


@query("SELECT (event_id - 7) // 100 AS win_id, count(*) AS n FROM events GROUP BY 1")
def tumbling_count(spark, sf):
    return W.tumbling(read(spark, sf, "events"), F.col("event_id"), 100, F.count("*").alias("n"), offset=7)


@query("SELECT event_id // 50 - s AS win_id, count(*) AS n FROM events, (SELECT unnest(range(0, 5)) AS s) GROUP BY 1")
def sliding_count_reference(spark, sf):
    return W.sliding(read(spark, sf, "events"), F.col("event_id"), 200, 50, F.count("*").alias("n"))


@query("SELECT event_id // 50 - s AS win_id, count(*) AS n FROM events, (SELECT unnest(range(0, 4)) AS s) GROUP BY 1")
def sliding_count_standard(spark, sf):
    return W.sliding(read(spark, sf, "events"), F.col("event_id"), 200, 50, F.count("*").alias("n"), mode="standard")


@query("SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(spark, sf):
    got = W.session(read(spark, sf, "events"), "user_id", "ts", "30 minutes", F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    return got.select("user_id", "began", "ended", "n")


# -- set operations -------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS item, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def append_all(spark, sf):
    a = Series.of(read(spark, sf, "customer"), "c_nationkey", "c_custkey")
    b = Series.of(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey")
    return a.append(b).df.groupBy("item").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT k AS item FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def union_distinct(spark, sf):
    a = Series.of(read(spark, sf, "customer"), "c_nationkey", "c_custkey")
    b = Series.of(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey")
    return a.union(b).df.select("item")


@query("SELECT k AS item FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)")
def bag_difference(spark, sf):
    a, b = Series.of(read(spark, sf, "customer"), "c_nationkey", "c_custkey"), Series.of(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey")
    return a.bag_difference(b)


@query("SELECT c_nationkey AS item FROM customer EXCEPT SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey AND r_name = 'ASIA'")
def set_difference(spark, sf):
    asia = read(spark, sf, "nation").join(read(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return Series.of(read(spark, sf, "customer"), "c_nationkey", "c_custkey").set_difference(Series.of(asia, "n_nationkey", "n_nationkey"))


@query("SELECT k AS item, sum(s)::BIGINT AS weight FROM (SELECT c_nationkey AS k, 1 AS s FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY k HAVING sum(s) <> 0")
def signed_bag(spark, sf):
    a, b = Series.of(read(spark, sf, "customer"), "c_nationkey", "c_custkey"), Series.of(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey")
    return a.weights(b)


# -- mappings ---------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def mapping_last_write(spark, sf):
    return Mapping.of_pairs(read(spark, sf, "events"), "user_id", "event_type", "event_id").pairs()


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'new' ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 5 <> 1")
def mapping_overlay(spark, sf):
    m = Mapping(read(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name")
    m = m.replace(m.df.where("n_nationkey % 4 = 0").withColumn("n_name", F.lit("new")))
    return m.remove(m.df.where("n_nationkey % 5 = 1")).commit_updates().pairs()


@query("SELECT n_nationkey, length(n_name) AS n_name FROM nation")
def mapping_project(spark, sf):
    return Mapping(read(spark, sf, "nation"), "n_nationkey", "n_name").project(lambda v: F.length(v).cast("long")).pairs()


@query("SELECT true AS equal, false AS other")
def mapping_equal(spark, sf):
    a = Mapping(read(spark, sf, "nation"), "n_nationkey", "n_name")
    b = Mapping(read(spark, sf, "nation").where("n_nationkey > 0"), "n_nationkey", "n_name")
    return a.equal(a).crossJoin(a.equal(b).withColumnRenamed("equal", "other"))  # one row each


@query("SELECT o_custkey AS key, CASE WHEN o_custkey % 2 = 0 THEN count(*) + 1 ELSE count(*) END AS value FROM orders GROUP BY 1")
def mapping_update_with(spark, sf):
    counts = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("value"))
    more = counts.where("key % 2 = 0").select("key", F.lit(1).cast("long").alias("value"))
    return Mapping(counts).update_with(more, lambda old, new: old + new).commit_updates().pairs()


# -- relations ----------------------------------------------------------------------------------------------


def _rel(spark, sf, table, left, right) -> L.Relation:
    return L.Relation.of_table(read(spark, sf, table), left, right)


@query("SELECT c_custkey AS cust, o_orderkey AS ord FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3")
def rel_map_join(spark, sf):
    cust, order = L.var("cust"), L.var("ord")
    clauses = [L.Clause(cust, _rel(spark, sf, "customer", "c_custkey", "c_nationkey"), L.value(3)), L.Clause(cust, _rel(spark, sf, "orders", "o_custkey", "o_orderkey"), order)]
    return L.run(spark, [cust, order], clauses)


@query("SELECT o_custkey AS cust, o_orderkey AS ord FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def rel_inv_join(spark, sf):
    cust, order = L.var("cust"), L.var("ord")
    status = _rel(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    clauses = [L.Clause(order, status, L.value("F")), L.Clause(cust, _rel(spark, sf, "orders", "o_custkey", "o_orderkey"), order)]
    return L.run(spark, [cust, order], clauses)


@query("SELECT n_nationkey AS n, r_regionkey AS r FROM nation, region")
def rel_generate(spark, sf):
    n, r = L.var("n"), L.var("r")
    names = _rel(spark, sf, "nation", "n_nationkey", "n_name")
    regions = _rel(spark, sf, "region", "r_regionkey", "r_name")
    return L.run(spark, [n, r], [L.Clause(n, names, L.__), L.Clause(r, regions, L.__)])


@query("SELECT c_custkey AS cust, c_nationkey AS n FROM customer SEMI JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
def rel_filter_semi(spark, sf):
    cust, n = L.var("cust"), L.var("n")
    return L.run(spark, [cust, n], [L.Clause(cust, _rel(spark, sf, "customer", "c_custkey", "c_nationkey"), n), L.Clause(cust, _rel(spark, sf, "supplier", "s_suppkey", "s_nationkey"), n)])


@query("SELECT c_custkey AS _l, n_regionkey AS _r FROM customer JOIN nation ON n_nationkey = c_nationkey")
def rel_compose(spark, sf):
    return _rel(spark, sf, "customer", "c_custkey", "c_nationkey").compose(_rel(spark, sf, "nation", "n_nationkey", "n_regionkey")).pairs


@query("SELECT n_regionkey AS _l, n_nationkey AS _r FROM nation")
def rel_inverse(spark, sf):
    return _rel(spark, sf, "nation", "n_nationkey", "n_regionkey").inverse().pairs


@query("SELECT o_orderkey AS ord, o_custkey AS cust FROM orders WHERE o_orderkey < o_custkey")
def rel_theta_lt(spark, sf):
    o, c = L.var("ord"), L.var("cust")
    return L.run(spark, [o, c], [L.Clause(o, _rel(spark, sf, "orders", "o_orderkey", "o_custkey"), c), L.Clause(o, L.theta("lt"), c)])


@query("SELECT c_custkey AS cust FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def rel_member(spark, sf):
    cust, nation, unit = L.var("cust"), L.var("nation"), L.value(0)
    held = L.Relation.of_collection(read(spark, sf, "supplier").select("s_nationkey").distinct(), "s_nationkey")
    return L.run(spark, [cust], [L.Clause(cust, _rel(spark, sf, "customer", "c_custkey", "c_nationkey"), nation), L.Clause(unit, held, nation)])


@query("SELECT c_name AS name, o_orderkey AS post, o_orderdate AS date FROM customer JOIN orders ON o_custkey = c_custkey")
def query_posts_of_author(spark, sf):
    a, name, post, date = (L.var(n) for n in ("author", "name", "post", "date"))
    orders = read(spark, sf, "orders")
    clauses = [L.Clause(a, _rel(spark, sf, "customer", "c_custkey", "c_name"), name), L.Clause(post, L.Relation.of_table(orders, "o_orderkey", "o_custkey"), a), L.Clause(post, L.Relation.of_table(orders, "o_orderkey", "o_orderdate"), date)]
    return L.run(spark, [name, post, date], clauses)


@query("SELECT c_custkey AS cust, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def query_three_hop(spark, sf):
    c, n, r, name = (L.var(x) for x in ("cust", "nation", "reg", "region"))
    clauses = [L.Clause(c, _rel(spark, sf, "customer", "c_custkey", "c_nationkey"), n), L.Clause(n, _rel(spark, sf, "nation", "n_nationkey", "n_regionkey"), r), L.Clause(r, _rel(spark, sf, "region", "r_regionkey", "r_name"), name)]
    return L.run(spark, [c, name], clauses)


@query("SELECT o_custkey AS _l, count(*) AS n FROM orders GROUP BY 1")
def rel_group_reduce(spark, sf):
    return _rel(spark, sf, "orders", "o_custkey", "o_orderkey").group(F.count("*").alias("n"))


@query("SELECT p_partkey AS part, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)")
def rel_plural_function(spark, sf):
    p, name, w = L.var("part"), L.var("name"), L.var("word")
    split = L.Relation.of_plural_function(lambda x: A.string_split(x, " "))
    return L.run(spark, [p, w], [L.Clause(p, _rel(spark, sf, "part", "p_partkey", "p_name"), name), L.Clause(name, split, w)])


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS lines FROM (SELECT o_custkey % 50 AS k, count(*) n FROM orders WHERE o_custkey % 50 < 40 GROUP BY 1) a FULL JOIN (SELECT l_suppkey % 50 AS k, count(*) n FROM lineitem WHERE l_suppkey % 50 > 5 GROUP BY 1) b ON a.k = b.k")
def cogroup_counts(spark, sf):
    a = read(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("k")).where("k < 40")
    b = read(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("k")).where("k > 5")
    return cogroup(a, b, "k", F.count("*").alias("orders"), F.count("*").alias("lines"), F.lit(0).cast("long"), F.lit(0).cast("long"))


@query("SELECT n_nationkey AS k, coalesce(a.t, 0)::BIGINT AS customers, coalesce(b.t, 0)::BIGINT AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, sum(c_custkey) t FROM customer GROUP BY 1) a ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, sum(s_suppkey) t FROM supplier GROUP BY 1) b ON s_nationkey = n_nationkey WHERE a.t IS NOT NULL OR b.t IS NOT NULL")
def co_group_sums(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    b = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return cogroup(a, b, "k", F.sum("c_custkey").alias("customers"), F.sum("s_suppkey").alias("suppliers"), F.lit(0).cast("long"), F.lit(0).cast("long"))


@query('SELECT r_name AS "left", n_name AS "right" FROM region, nation')
def cross_product(spark, sf):
    a = Series.of(read(spark, sf, "region"), "r_name", "r_regionkey")
    return a.cross_product(Series.of(read(spark, sf, "nation"), "n_name", "n_nationkey"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, sf):
    big = read(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey")
    return Mapping(read(spark, sf, "customer"), "c_custkey", "c_name").remove(big.select(F.col("o_custkey").alias("c_custkey"))).keys()


# -- ranges ---------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE (l_quantity >= 10 AND l_quantity < 20) OR (l_quantity >= 15 AND l_quantity <= 30) OR l_quantity = 45")
def range_dnf_filter(spark, sf):
    e = G.Or(G.Or(G.And(G.ge(10.0), G.lt(20.0)), G.between(15.0, 30.0)), G.eq(45.0))
    return read(spark, sf, "lineitem").where(G.column(e, F.col("l_quantity"))).select("l_orderkey", "l_quantity")


@query("SELECT p_partkey, p_size FROM part WHERE NOT ((p_size > 10 AND p_size <= 20) OR p_size = 3)")
def range_negation(spark, sf):
    e = G.Not(G.Or(G.And(G.gt(10), G.le(20)), G.eq(3)))
    return read(spark, sf, "part").where(G.column(e, F.col("p_size"))).select("p_partkey", "p_size")


@query("SELECT a.o_orderkey AS a, b.p_partkey AS b FROM orders a JOIN part b ON a.o_orderkey <= b.p_partkey * 7 + 9 AND b.p_partkey * 7 <= a.o_orderkey + 3")
def range_overlap_join(spark, sf):
    a = read(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_orderkey").alias("a0"), (F.col("o_orderkey") + 3).alias("a1"))
    b = read(spark, sf, "part").select(F.col("p_partkey").alias("b"), (F.col("p_partkey") * 7).alias("b0"), (F.col("p_partkey") * 7 + 9).alias("b1"))
    return G.overlap_join(a, b, ("a0", "a1"), ("b0", "b1"), 16).select("a", "b")


# -- codecs and scalars ------------------------------------------------------------------------------------------


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_decode_props(spark, sf):
    return dealt(read(spark, sf, "events")).select("event_id", F.explode(C.json_decode(C.record(k=C.Int), F.col("props"))).alias("p")).select("event_id", F.col("p.k").alias("k"))


@query("SELECT c_custkey, c_name AS name, c_nationkey::BIGINT AS nation FROM customer")
def json_roundtrip(spark, sf):
    shape = C.record(name=C.String, pair=C.tuple_of(C.Int, C.ListOf(C.String)))
    value = F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").cast("long").alias("_1"), F.array("c_mktsegment").alias("_2")).alias("pair"))
    text = C.json_encode(shape, value)
    got = dealt(read(spark, sf, "customer")).select("c_custkey", F.explode(C.json_decode(shape, text)).alias("v"))
    return got.select("c_custkey", F.col("v.name").alias("name"), F.col("v.pair._1").alias("nation"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS same FROM orders")
def struct_equality(spark, sf):
    shape = C.record(a=C.String, b=C.Int)
    a = F.struct(F.col("o_orderstatus").alias("a"), F.col("o_orderkey").alias("b"))
    b = F.struct(F.lit("F").alias("a"), F.col("o_orderkey").alias("b"))
    return read(spark, sf, "orders").agg(F.sum(C.structural_equal(shape, a, b).cast("long")).alias("same"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey + l_partkey * 2 - 5) AS a, (l_orderkey - 100) // 7 AS q, (l_orderkey - 100) % 7 AS r FROM lineitem")
def scalar_arith(spark, sf):
    from cairn.lang.builtins import BUILTINS

    op = lambda name, a, b: BUILTINS[name][1](a)(b)
    key, less = F.col("l_orderkey"), op("-", F.col("l_orderkey"), 100)
    a = op("-", op("+", key, op("*", F.col("l_partkey"), 2)), 5)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), op("/", less, 7).alias("q"), op("mod", less, 7).alias("r"))


@query("SELECT o_orderkey, o_orderkey < o_custkey AS lt, o_orderkey >= o_custkey AS ge, o_orderstatus = 'F' AND NOT (o_custkey > 50) AS both FROM orders")
def scalar_compare(spark, sf):
    from cairn.lang.builtins import BUILTINS

    op = lambda name, a, b: BUILTINS[name][1](a)(b)
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    both = op("and", BUILTINS["equal"][1](None)(F.col("o_orderstatus"))("F"), BUILTINS["not"][1](op(">", c, 50)))
    return read(spark, sf, "orders").select(o, op("<", o, c).alias("lt"), op(">=", o, c).alias("ge"), both.alias("both"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size FROM part")
def scalar_if(spark, sf):
    from cairn.lang.builtins import if_then_else

    return read(spark, sf, "part").select("p_partkey", if_then_else(F.col("p_size") > 25, lambda _: "big", lambda _: "small").alias("size"))


@query("SELECT p_partkey, p_brand || '/' || p_type AS joined FROM part")
def scalar_concat(spark, sf):
    from cairn.lang.builtins import BUILTINS

    join = lambda a, b: BUILTINS["++"][1](a)(b)
    return read(spark, sf, "part").select("p_partkey", join(join(F.col("p_brand"), "/"), F.col("p_type")).alias("joined"))


# -- changelogs -----------------------------------------------------------------------------------------------------

_MOVES = """WITH e AS (SELECT event_id, user_id, event_type AS new, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events),
c AS (SELECT * FROM e WHERE old IS DISTINCT FROM new),
m AS (SELECT event_id AS pos, 0 AS step, user_id AS key, -1 AS sign, old AS value FROM c WHERE old IS NOT NULL UNION ALL SELECT event_id, 1, user_id, 1, new FROM c) """


def _moves(spark, sf) -> DataFrame:
    return group_updates(read(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", lambda: F.last("event_type"))


@query(_MOVES + "SELECT * FROM m")
def group_updates_changelog(spark, sf):
    return _moves(spark, sf)


@query(_MOVES + "SELECT pos, step, value, sum(sign) OVER (PARTITION BY value ORDER BY pos, step, key)::BIGINT AS count FROM m")
def changelog_running_count(spark, sf):
    return running_counts(_moves(spark, sf))


@query(_MOVES + "SELECT value, sum(sign)::BIGINT AS count FROM m GROUP BY value")
def changelog_net_count(spark, sf):
    return _moves(spark, sf).groupBy("value").agg(F.sum("sign").alias("count"))


def _streamed(spark: SparkSession, build, sf: str) -> DataFrame:
    """Runs a stream over what is there, into a table in a fresh folder, and reads that."""
    where = scratch(spark, "stream")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{where}/value")

    build(spark, sf).log(write).run(f"{where}/checkpoint")
    return spark.read.parquet(f"{where}/value")


def _source(spark: SparkSession, sf: str, name: str, columns: list):
    from cairn.streaming.incremental import Producer

    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a folder of part files or a single file, which is read by its name in the folder above
    reader = spark.readStream.schema(schema)
    if not _is_folder(spark, path):
        reader, path = reader.option("pathGlobFilter", f"{name}.parquet"), sf
    return Producer.of(reader.parquet(path)).map(*columns)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM documents) GROUP BY w")
def stream_word_count(spark, sf):
    return _streamed(spark, lambda s, d: _source(s, d, "documents", [F.explode(A.string_words(F.col("text"))).alias("word")]).group(["word"], F.count("*").alias("n")), sf)


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def stream_group(spark, sf):
    return _streamed(spark, lambda s, d: _source(s, d, "events", [F.col("event_type"), F.col("user_id")]).group(["event_type"], F.count("*").alias("n"), F.sum("user_id").alias("users")), sf)


@query("SELECT word, n FROM (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM documents) GROUP BY w) ORDER BY n DESC, word LIMIT 10")
def stream_top_words(spark, sf):
    def build(s, d):
        counts = _source(s, d, "documents", [F.explode(A.string_words(F.col("text"))).alias("word")]).group(["word"], F.count("*").alias("n"))
        return counts.view(lambda df: df.orderBy(F.col("n").desc(), "word").limit(10))

    return _streamed(spark, build, sf)


@query(_MOVES + "SELECT pos, step, key, sign, value FROM m")
def stream_group_updates(spark, sf):
    from cairn.streaming.changelog import stream_group_updates as updates

    def build(s, d):
        rows = _source(s, d, "events", [F.col("event_id"), F.col("user_id"), F.col("event_type")])
        return rows.through(lambda df: updates(df, "user_id", "event_id", None, lambda _, r: r.event_type, lambda v: v, "long", "string"))

    return _streamed(spark, build, sf)


@query("SELECT 'V' || user_id AS visitor, event_type AS room, event_id AS timestamp FROM events")
def decode_position_messages(spark, sf):
    text = F.to_json(F.struct(F.concat(F.lit("V"), "user_id").alias("visitor"), F.col("event_type").alias("room"), F.col("event_id").alias("timestamp")))
    return apps.decode_positions(read(spark, sf, "events").select(text.alias("value")))
