"""Queries that go through single operators of the library: stores, generators, reducers, codecs, streams and the language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import arrays as A
from cairn.functions import codecs as C
from cairn.functions import keypaths as K
from cairn.functions import reducer as R
from cairn.lang.interpreter import Session
from cairn.operators import relation as L
from cairn.operators.mapping import Mapping
from cairn.operators.series import Series
from cairn.plans.driver_queries import _rel, _source, _streamed, dealt, events, query, read, scratch
from cairn.sources import files, sinks, stores
from cairn.sources.keyvalue import KeyValue, loaded_struct, stored_struct
from cairn.streaming import changelog as S

# -- files -------------------------------------------------------------------------------------


def _text(spark: SparkSession, sf: str, table: str, column) -> str:
    where = scratch(spark, "text")
    read(spark, sf, table).select(column).write.text(where)
    return where


@query("SELECT p_name AS line, count(*) AS n FROM part GROUP BY 1")
def file_lines(spark, sf):
    return files.file_lines(spark, _text(spark, sf, "part", "p_name")).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(p_name, '[a-zA-Z]+')) AS w FROM part) GROUP BY 1")
def file_words(spark, sf):
    return files.words(files.file_lines(spark, _text(spark, sf, "part", "p_name"))).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT piece, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' |', ' ')) AS piece FROM part) GROUP BY 1")
def file_split(spark, sf):
    text = _text(spark, sf, "part", F.concat("p_name", F.lit(" |")))
    pieces = files.file_split(spark, text, " ")
    # a line's end stands between its last piece and the next line's first one
    return pieces.select(F.explode(F.split("value", "\n")).alias("piece")).where("piece <> ''").groupBy("piece").agg(F.count("*").alias("n"))


@query("SELECT sum(length(c_name) + 1)::BIGINT AS bytes, 1 AS smallest FROM customer")
def file_chunks(spark, sf):
    chunks = files.file_chunks(spark, _text(spark, sf, "customer", "c_name"), 64)
    return chunks.agg(F.sum(F.length("chunk")).alias("bytes"), F.least(F.min(F.length("chunk")), F.lit(1)).alias("smallest"))


@query("SELECT count(*) AS files FROM range(5)")
def files_of_a_folder(spark, sf):
    where = scratch(spark, "files")
    spark.range(0, 50, 1, 5).select(F.col("id").cast("string")).write.text(where)
    return files.files(spark, where).where("path LIKE '%.txt'").agg(F.count("*").alias("files"))


# -- key-value stores ----------------------------------------------------------------------------


def _customers(spark: SparkSession, sf: str) -> KeyValue:
    kv = KeyValue(spark, scratch(spark, "kv"))
    kv.write(read(spark, sf, "customer").select(F.col("c_name").alias("k"), F.col("c_mktsegment").alias("v")))
    return kv


@query("SELECT c_name AS k, c_mktsegment AS v FROM customer")
def kv_all_pairs(spark, sf):
    return _customers(spark, sf).pairs()


@query("SELECT c_mktsegment AS v FROM customer WHERE c_name = 'Customer#000000007'")
def kv_get_values(spark, sf):
    return _customers(spark, sf).get("Customer#000000007")


@query("SELECT c_name AS k, c_mktsegment AS v FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def kv_pairs_with_prefix(spark, sf):
    return _customers(spark, sf).pairs_with_prefix("Customer#00000001")


@query("SELECT c_name AS k, c_mktsegment AS v FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000055'")
def kv_pairs_within_range(spark, sf):
    return _customers(spark, sf).pairs_within_range("Customer#000000010", "Customer#000000055")


@query("SELECT c_name AS k, CASE WHEN c_custkey % 5 = 1 THEN 'new' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 3 <> 2 OR c_custkey % 5 = 1")
def kv_update(spark, sf):
    kv, rows = _customers(spark, sf), read(spark, sf, "customer")
    new = rows.where("c_custkey % 5 = 1").select(F.col("c_name").alias("k"), F.lit("new").alias("v"), F.lit(False).alias("removed"))
    gone = rows.where("c_custkey % 3 = 2 AND c_custkey % 5 <> 1").select(F.col("c_name").alias("k"), F.lit(None).cast("string").alias("v"), F.lit(True).alias("removed"))
    kv.update(new.unionByName(gone))
    return kv.pairs()


@query("SELECT event_type AS k, count(*) AS v FROM events GROUP BY 1")
def kv_store_of_a_stream(spark, sf):
    """Each batch is folded in twice, and counts once."""
    kv = KeyValue(spark, scratch(spark, "kv"), "long")
    counts = read(spark, sf, "events").groupBy(F.col("event_type").alias("k"), (F.col("event_id") % 3).alias("b")).agg(F.count("*").alias("v"))
    for batch in range(3):
        for _ in range(2):
            kv.fold_in(counts.where(F.col("b") == batch).select("k", "v"), lambda old, new: old + new, batch)
    return kv.pairs()


@query("SELECT c_name AS k, c_custkey AS v FROM customer")
def kv_encoded(spark, sf):
    kv = KeyValue(spark, scratch(spark, "kv"), encoding=C.encoding("marshal", C.Int))
    kv.write(read(spark, sf, "customer").select(F.col("c_name").alias("k"), C.marshal_encode(C.Int, F.col("c_custkey")).alias("v")))
    return kv.mapping().pairs()


@query("SELECT c_custkey::VARCHAR AS key, '\"' || c_name || '\"' AS name, c_nationkey::VARCHAR AS nation FROM customer")
def kv_hierarchy(spark, sf):
    shape = C.record(name=C.String, at=C.tuple_of(C.Int, C.Int))
    value = F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_custkey").alias("_1"), F.col("c_nationkey").cast("long").alias("_2")).alias("at"))
    rows = stored_struct(read(spark, sf, "customer"), F.col("c_custkey"), C.key_paths(shape, value))
    return loaded_struct(rows, ["name", "at/1"]).select("key", "name", F.col("at/1").alias("nation"))


@query("SELECT p_partkey, 'a/0' AS first, 'a/1' AS next, 'p' || p_size AS suffix FROM part")
def key_paths(spark, sf):
    path = F.array(F.lit("a"), F.lit("0"))
    joined = lambda c: F.array_join(c, "/")
    suffix = K.extract_suffix(F.array(F.lit("a")), K.add_suffix(F.array(F.lit("a")), F.concat(F.lit("p"), "p_size")))
    return read(spark, sf, "part").select("p_partkey", joined(K.first_index(F.array(F.lit("a")))).alias("first"), joined(K.next_index(path)).alias("next"), joined(suffix).alias("suffix"))


@query("SELECT sum(o_custkey)::BIGINT AS total, count(*) AS n FROM orders")
def state_stores(spark, sf):
    """A fold in three steps, whose pair of states is loaded before each and saved after it."""
    total, n = stores.file_store(spark, scratch(spark, "total"), 0), stores.key_store(KeyValue(spark, scratch(spark, "kv")), "n", 0)
    rows = read(spark, sf, "orders")
    for step in range(3):
        held = stores.product(total, n)
        a, b = held.load()
        r = rows.where(F.col("o_orderkey") % 3 == step).agg(F.sum("o_custkey").alias("a"), F.count("*").alias("b")).first()
        held.save((a + (r["a"] or 0), b + r["b"]))
    return spark.createDataFrame([stores.product(total, n).load()], "total long, n long")


# -- sinks -------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def file_logger(spark, sf):
    where, rows = scratch(spark, "log"), read(spark, sf, "orders")
    write = sinks.file_logger(where, "o_orderpriority")
    for batch in (0, 1, 1):  # a batch that is replayed replaces its first try
        write(rows.where(F.col("o_orderkey") % 2 == batch), batch)
    return spark.read.text(where).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1")
def file_view(spark, sf):
    where, rows = scratch(spark, "view"), read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    write = sinks.file_view(where)
    write(rows.where("n < 0"), 0)
    write(rows, 1)
    return KeyValue(spark, where).pairs().select("k", F.get_json_object("v", "$.n").cast("long").alias("n"))


@query("SELECT event_type AS value, 1 AS partitions, count(*) AS n FROM events GROUP BY 1")
def topic_by_key(spark, sf):
    where = scratch(spark, "topic")
    sinks.topic_logger(where, F.col("event_type"), 3, "event_type")(read(spark, sf, "events"), 0)
    return spark.read.parquet(where).groupBy("value").agg(F.count_distinct("partition").alias("partitions"), F.count("*").alias("n"))


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def topic_stream(spark, sf):
    topic, out = scratch(spark, "topic"), scratch(spark, "out")
    sinks.topic_logger(topic, None, 3, "event_type")(read(spark, sf, "events"), 0)
    stream = sinks.topic_stream(spark, topic).where("value <> 'view'")
    write = lambda df, n: df.write.mode("append").parquet(out)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'rest' END AS route, count(*) AS n FROM events GROUP BY 1")
def routed_sinks(spark, sf):
    where = {name: scratch(spark, name) for name in ("click", "view", "rest")}
    to = lambda name: sinks.file_logger(where[name], "event_type")
    sinks.fan_out(sinks.routed({"click": to("click"), "view": to("view"), "*": to("rest")}, "event_type"))(read(spark, sf, "events"), 0)
    out = None
    for name, path in where.items():
        one = spark.read.text(path).agg(F.lit(name).alias("route"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


# -- generators ----------------------------------------------------------------------------------------


@query("SELECT 1 AS pos, 'a' AS item UNION ALL SELECT 2, 'b' UNION ALL SELECT 3, 'c' UNION ALL SELECT 4, 'z'")
def constructors(spark, sf):
    s = Series.of_list(spark, ["b", "c"], "string").cons(F.lit("a")).append(Series.of_option(spark, "z", "string")).append(Series.of_option(spark, None, "string")).append(Series.empty(spark, "string"))
    return Series(s.df, "item", s.pos).numbered("pos").select(F.col("pos").cast("int").alias("pos"), "item")


@query("SELECT n_nationkey::BIGINT AS key, n_name AS value FROM nation")
def of_hashtbl(spark, sf):
    table = {r.n_nationkey: r.n_name for r in read(spark, sf, "nation").collect()}  # a driver's table is the operator's input
    return Series.of_hashtbl(spark, table, "long", "string").df.select("item._1", "item._2").toDF("key", "value")


@query("SELECT o_orderkey, len(range(o_orderkey % 5, 5)) AS a, len(range(o_orderkey % 5 + 1, 5)) AS b, len(range(o_orderkey % 5 + 1, 4)) AS c FROM orders")
def open_ranges(spark, sf):
    low, high = F.col("o_orderkey") % 5, F.lit(4).cast("long")
    n = lambda a, b: F.size(A.range_open(low, high, a, b)).cast("long")
    return read(spark, sf, "orders").select("o_orderkey", n(False, False).alias("a"), n(True, False).alias("b"), n(True, True).alias("c"))


@query("SELECT o_orderkey, (o_orderkey % 7)::BIGINT AS items, coalesce((o_orderkey % 7) * (o_orderkey % 7 - 1) // 2, 0)::BIGINT AS total FROM orders")
def bounded_generator(spark, sf):
    end = F.col("o_orderkey") % 7
    xs = A.bounded_generate(F.lit(0).cast("long"), lambda s: (s + 1, s), lambda s: s >= end, 7)
    return read(spark, sf, "orders").select("o_orderkey", F.size(xs).cast("long").alias("items"), R.sum_().over_array(xs).alias("total"))


@query("SELECT range AS pos, range * (range + 1) // 2 AS item FROM range(0, 30)")
def generated_series(spark, sf):
    """An endless series of which 30 items are taken."""
    s = Series.of_generator(spark, (0, 1), lambda s: ((s[0] + s[1], s[1] + 1), s[0]), lambda s: False, "long", 30)
    return s.df.select(F.col("_pos").alias("pos"), "item")


@query("SELECT count(*) AS n FROM range(4000)")
def series_of_a_source(spark, sf):
    return Series.of_source(spark, lambda: (f"line {k}" for k in range(4000)), "string").length().toDF("n")


# -- series ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS pos, o_orderpriority AS item FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL SELECT (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 LIMIT 1), '...'")
def take_no_more_than(spark, sf):
    s = Series.of(read(spark, sf, "orders"), "o_orderpriority", "o_orderkey").take_no_more_than(5, F.lit("..."))
    return s.df.select(F.col(s.pos).alias("pos"), "item")


@query("SELECT -1 AS part, 'first' AS item, 1::BIGINT AS n UNION ALL SELECT 0, event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 1, 'last', 1")
def cons_and_sonc(spark, sf):
    s = events(spark, sf).cons(F.lit("first")).sonc(F.lit("last"))
    place = F.when(F.col("item") == "first", -1).when(F.col("item") == "last", 1).otherwise(0)
    return s.df.groupBy(place.alias("part"), "item").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 2 = 0")
def transduce_by_key(spark, sf):
    s = Series(read(spark, sf, "events").select(F.col("event_id").alias("_pos"), "user_id", F.col("event_id").alias("item")), "item")
    step = lambda n, r: (n + 1, [(r.user_id, r.item, n + 1)] if n % 2 else [])
    return s.transduce(0, step, lambda n: [], "user_id long, event_id long, n long", "user_id")


@query("SELECT n_nationkey AS pos, n_name AS item, 'nation ' || n_nationkey AS label, n_nationkey * 2 AS twice FROM nation")
def record_extension(spark, sf):
    s = Series.of(read(spark, sf, "nation").withColumn("n_nationkey", F.col("n_nationkey")), "n_name", "n_nationkey")
    t = s.with_(label=lambda x: F.concat(F.lit("nation "), F.col("_pos")), twice=lambda x: F.col("_pos") * 2)
    return t.df.withColumnRenamed("_pos", "pos")


@query("SELECT w AS item, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def concat_series(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("_pos"), A.string_split(F.col("p_name"), " ").alias("item"))
    return Series(rows, "item").concat().df.groupBy("item").agg(F.count("*").alias("n"))


@query("SELECT event_id AS pos, max(value) OVER (ORDER BY event_id) AS high, count(*) OVER (ORDER BY event_id) AS n FROM events")
def rolling_without_key(spark, sf):
    s = events(spark, sf, "value")
    high, n = s.rolling(F.max, "high", plus=lambda a, b: F.greatest(a, b)), s.rolling(lambda x: F.count(F.lit(1)), "n", plus=lambda a, b: a + b)
    return high.df.select(F.col("_pos").alias("pos"), "high").join(n.df.select(F.col("_pos").alias("pos"), "n"), "pos")


# -- reducers ----------------------------------------------------------------------------------------------------


def _pairs(spark, sf, key: str = "user_id", value: str = "event_id") -> Series:
    rows = read(spark, sf, "events").select(F.col("event_id").alias("_pos"), F.struct(F.col(key).alias("_1"), F.col(value).alias("_2")).alias("item"))
    return Series(rows, "item")


def _by_key(s: Series, r: R.Reducer) -> DataFrame:
    return s.group(lambda x: x["_1"], lambda x: x["_2"], r).pairs()


@query("SELECT user_id AS key, count(*) * 3 AS value FROM events GROUP BY 1")
def monoid_in_chunks(spark, sf):
    r = R.monoid(F.lit(0).cast("long"), lambda a, b: a + b).mapping(lambda x: F.lit(3).cast("long"))
    return _by_key(_pairs(spark, sf), r)


@query("SELECT string_agg(event_type[1:1], '' ORDER BY event_id) AS joined FROM events")
def monoid_keeps_order(spark, sf):
    return events(spark, sf).map(lambda x: F.left(x, F.lit(1))).reduce(R.monoid(F.lit(""), lambda a, b: F.concat(a, b)), "joined")


@query("SELECT user_id AS key, least(count(*), 5) AS value FROM events GROUP BY 1")
def monoid_with_maximum(spark, sf):
    r = R.monoid_with_maximum(F.lit(0).cast("long"), lambda a, b: F.least(a + b, F.lit(5).cast("long")), F.lit(5).cast("long"))
    return _by_key(_pairs(spark, sf), r.mapping(lambda x: F.lit(1).cast("long")))


@query("SELECT user_id AS key, 100 + sum(event_id % 10)::BIGINT AS value FROM events GROUP BY 1")
def reducer_with_seed(spark, sf):
    return _by_key(_pairs(spark, sf), R.with_seed(F.lit(100).cast("long"), lambda a, x: a + x % 10))


@query("SELECT user_id AS key, (max(event_id) - min(event_id))::BIGINT AS value FROM events GROUP BY 1")
def reducer_of_parts(spark, sf):
    """seed, push, plus and finish of the caller's own."""
    seed = F.struct(F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    both = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    r = R.make(seed, lambda s, x: both(F.least(s["lo"], x), F.greatest(s["hi"], x)), lambda a, b: both(F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"])), lambda s: s["hi"] - s["lo"])
    return _by_key(_pairs(spark, sf), r)


@query("SELECT user_id AS key, string_agg(event_id % 3, ',' ORDER BY event_id) AS value FROM events GROUP BY 1")
def fold_in_order(spark, sf):
    r = R.fold(F.lit(""), lambda s, x: F.when(s == "", (x % 3).cast("string")).otherwise(F.concat(s, F.lit(","), (x % 3).cast("string"))))
    return _by_key(_pairs(spark, sf), r)


@query("SELECT user_id AS key, sum(event_id % 3)::BIGINT AS value FROM events GROUP BY 1")
def flat_mapping_reducer(spark, sf):
    return _by_key(_pairs(spark, sf), R.count().flat_mapping(lambda x: F.array_repeat(x, (x % 3).cast("int"))))


@query("SELECT user_id AS key, (sum(event_id) FILTER (event_id % 2 = 0) + coalesce(sum(event_id) FILTER (event_id % 2 = 0), 0))::BIGINT AS value FROM events GROUP BY 1")
def union_reducer(spark, sf):
    twice = R.union(R.sum_()).mapping(lambda x: F.when(x % 2 == 0, F.array(x, x)).otherwise(F.slice(F.array(x), 1, 0)))
    return _by_key(_pairs(spark, sf), twice)


@query("SELECT user_id AS key, count(*) AS value FROM events GROUP BY 1")
def unnesting_reducer(spark, sf):
    r = R.count().filtering(lambda p: p["_1"] == 0).unnesting(lambda x: F.array(F.lit(0), F.lit(1)))
    return _by_key(_pairs(spark, sf), r)


@query("SELECT sum(event_id) FILTER (event_type = 'click')::BIGINT AS clicks, count(*) FILTER (event_id % 2 = 0) AS even, sum(user_id * 2)::BIGINT AS twice FROM events")
def reducers_of_pairs(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_id").alias("_pos"), F.struct(F.col("event_type").alias("_1"), "event_id", F.col("user_id").alias("_3")).alias("item"))
    pair = lambda s: s.map(lambda x: F.struct(x["_1"].alias("_1"), x["event_id"].alias("_2")))
    second = R.sum_().mapping(lambda x: x["_2"])
    s = pair(Series(rows, "item"))
    clicks = s.reduce(R.filter_fst(second, lambda t: t == "click"), "clicks")
    even = s.reduce(R.filter_snd(R.count(), lambda n: n % 2 == 0), "even")
    users = Series(rows, "item").map(lambda x: F.struct(x["_1"].alias("_1"), x["_3"].alias("_2")))
    twice = users.reduce(R.map_snd(R.map_fst(second, F.upper), lambda n: n * 2), "twice")
    return clicks.crossJoin(even).crossJoin(twice)  # one row each


@query("SELECT event_type AS key, map_keys AS users, total FROM (SELECT event_type, count(DISTINCT user_id) AS map_keys, count(*) AS total FROM events GROUP BY 1)")
def nested_group_reducer(spark, sf):
    s = _pairs(spark, sf, "event_type", "user_id")
    m = _by_key(s, R.group(lambda x: x, lambda x: x, R.count()))
    return m.select("key", F.size("value").cast("long").alias("users"), F.aggregate(F.map_values("value"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT item::BIGINT AS item, n::BIGINT AS weight FROM (SELECT o_orderkey % 10 AS item, sum(CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END) AS n FROM orders GROUP BY 1) WHERE n <> 0")
def signed_bag_reducer(spark, sf):
    o = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(o.alias("_pos"), F.struct((o % 10).alias("_1"), F.when(o % 4 == 0, -1).otherwise(1).alias("_2")).alias("item"))
    got = Series(rows, "item").reduce(R.signed_bag(), "bag")
    return got.select(F.explode("bag").alias("item", "weight"))


@query("SELECT array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ',') AS words, sum(len(string_split(p_name, ' ')))::BIGINT AS n FROM part")
def set_and_bag_union(spark, sf):
    s = Series(read(spark, sf, "part").select(F.col("p_partkey").alias("_pos"), A.string_split(F.col("p_name"), " ").alias("item")), "item")
    words = s.reduce(R.set_union().project(lambda xs: F.array_join(xs, ",")), "words")
    return words.crossJoin(s.reduce(R.bag_union().project(lambda xs: F.size(xs).cast("long")), "n"))  # one row each


@query("SELECT o_orderkey % 20 AS key, bool_and(o_orderkey >= 0) AS everything, bool_or(o_orderkey = 7) AS seven, max(o_custkey) AS high, min(o_custkey) AS low, 0 AS nothing FROM orders GROUP BY 1")
def monoid_library(spark, sf):
    x, o = F.col("o_custkey"), F.col("o_orderkey")
    of = lambda r, c=x: r.over_rows(c, o)
    return read(spark, sf, "orders").groupBy((o % 20).alias("key")).agg(of(R.and_(), o >= 0).alias("everything"), of(R.or_(), o == 7).alias("seven"), of(R.maximum()).alias("high"), of(R.minimum()).alias("low"), of(R.void(F.lit(0))).alias("nothing"))


@query("SELECT 362880::BIGINT AS factorial, '[1; 2; 3]' AS shown, 3 AS held")
def product_show_and_buffer(spark, sf):
    s = Series.range(spark, 1, 9)
    first = s.take(3)
    shown = first.reduce(R.show().mapping(lambda x: x.cast("string")), "shown")
    return s.reduce(R.product_(), "factorial").crossJoin(shown).crossJoin(s.reduce(R.of_buffer(3).project(F.size), "held"))  # one row each


@query("SELECT o_orderkey % 3 AS key, count(*) AS n, max(o_orderkey) AS newest FROM orders GROUP BY 1")
def partition_series(spark, sf):
    parts = Series.of(read(spark, sf, "orders"), "o_orderkey", "o_orderkey").partition(lambda x: x % 3).pairs()
    return parts.select("key", F.size("value").cast("long").alias("n"), F.get("value", F.lit(0)).alias("newest"))


@query("SELECT count(*) >= 20000 AS many, count(*) <= 5 AS few, least(count(*), 7) AS seven FROM orders")
def counts_that_stop(spark, sf):
    s = Series(read(spark, sf, "orders"), "o_orderkey", "o_orderkey")
    return s.at_least(20000).toDF("many").crossJoin(s.at_most(5).toDF("few")).crossJoin(s.count_at_most(7).toDF("seven"))  # one row each


# -- mappings and relations -----------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS key FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT NULL")
def mapping_null_key(spark, sf):
    df = read(spark, sf, "nation").selectExpr("n_nationkey AS key", "n_name AS value").unionAll(spark.sql("SELECT CAST(NULL AS INT), 'none'"))
    m = Mapping(df).replace(spark.sql("SELECT CAST(NULL AS INT) AS key, 'other' AS value")).remove(spark.sql("SELECT 3 AS key"))
    return m.rollback_updates().remove(spark.sql("SELECT 3 AS key")).replace(spark.sql("SELECT CAST(NULL AS INT) AS key, 'again' AS value")).keys()


@query("SELECT n_name AS value FROM nation WHERE n_nationkey = 7")
def mapping_value(spark, sf):
    return Mapping(read(spark, sf, "nation"), "n_nationkey", "n_name").get(7).toDF("value")


@query("SELECT o_orderkey AS ord, o_custkey AS cust, (o_orderkey = o_custkey) AS eq FROM orders WHERE o_orderkey >= o_custkey")
def rel_theta_ge_eq(spark, sf):
    o, c = L.var("ord"), L.var("cust")
    order = _rel(spark, sf, "orders", "o_orderkey", "o_custkey")
    ge = L.run(spark, [o, c], [L.Clause(o, order, c), L.Clause(o, L.theta("ge"), c)])
    eq = L.run(spark, [o, c], [L.Clause(o, order, c), L.Clause(o, L.theta("eq"), c)]).withColumn("eq", F.lit(True))
    return ge.join(eq, ["ord", "cust"], "left").select("ord", "cust", F.coalesce("eq", F.lit(False)).alias("eq"))


@query("SELECT count(*) FILTER (o_orderkey <> o_custkey) AS ne, count(*) FILTER (o_orderkey <= o_custkey) AS le, count(*) FILTER (o_orderkey > o_custkey) AS gt FROM orders")
def rel_theta_counts(spark, sf):
    o, c, out = L.var("ord"), L.var("cust"), None
    for op in ("ne", "le", "gt"):
        n = L.run(spark, [o, c], [L.Clause(o, _rel(spark, sf, "orders", "o_orderkey", "o_custkey"), c), L.Clause(o, L.theta(op), c)]).agg(F.count("*").alias(op))
        out = n if out is None else out.crossJoin(n)  # one row each
    return out


@query("SELECT n_nationkey AS nation FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def rel_generate_member(spark, sf):
    nation, unit = L.var("nation"), L.value(0)
    held = read(spark, sf, "supplier").select("s_nationkey").distinct()
    clauses = [L.Clause(unit, L.Relation.of_collection(held, "s_nationkey"), nation), L.Clause(nation, _rel(spark, sf, "nation", "n_nationkey", "n_name"), L.__)]
    return L.run(spark, [nation], clauses)


@query("SELECT c_custkey AS cust, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def rel_of_mapping(spark, sf):
    cust, nation, name = L.var("cust"), L.var("nation"), L.var("name")
    names = L.Relation.of_mapping(read(spark, sf, "nation"), "n_nationkey", "n_name")
    return L.run(spark, [cust, name], [L.Clause(cust, _rel(spark, sf, "customer", "c_custkey", "c_nationkey"), nation), L.Clause(nation, names, name)])


@query("SELECT o_orderkey AS ord, o_orderkey * 2 AS twice FROM orders")
def rel_of_function(spark, sf):
    o, t = L.var("ord"), L.var("twice")
    double = L.Relation.of_function(lambda x: x * 2, lambda y: F.expr("CAST(NULL AS BIGINT)") + y)
    return L.run(spark, [o, t], [L.Clause(o, _rel(spark, sf, "orders", "o_orderkey", "o_custkey"), L.__), L.Clause(o, double, t)])


@query("SELECT n_regionkey AS region, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY 1")
def rel_reduce_into_monoid(spark, sf):
    """A query's rows folded straight into a monoid for each group."""
    n, r, name = L.var("nation"), L.var("region"), L.var("name")
    rows = L.run(spark, [r, name], [L.Clause(n, _rel(spark, sf, "nation", "n_nationkey", "n_regionkey"), r), L.Clause(n, _rel(spark, sf, "nation", "n_nationkey", "n_name"), name)])
    s = Series(rows.select(F.col("name").alias("_pos"), F.struct("region", "name").alias("item")), "item")
    names = R.monoid(F.array().cast("array<string>"), lambda a, b: F.concat(a, b)).mapping(lambda x: F.array(x)).project(lambda xs: F.array_join(xs, ","))
    return s.group(lambda x: x["region"], lambda x: x["name"], names, ("region", "names")).pairs()


# -- codecs ----------------------------------------------------------------------------------------------------------------


def _decoded(spark, sf, table: str, key: str, shape: C.Shape, text, *out) -> DataFrame:
    return dealt(read(spark, sf, table)).select(key, F.explode(C.json_decode(shape, text)).alias("v")).select(key, *out)


@query("SELECT p_partkey, p_size::BIGINT AS n FROM part")
def json_int_from_text(spark, sf):
    text = F.format_string('{"n":"%d","more":[1,{}],"n":7}', "p_size")  # extra fields don't count, nor do repeated ones
    return _decoded(spark, sf, "part", "p_partkey", C.record(n=C.Int), text, F.col("v.n").alias("n"))


@query("SELECT p_partkey, p_retailprice AS price, p_size > 25 AS big FROM part WHERE p_size % 3 <> 0")
def json_floats_and_bools(spark, sf):
    """Every third text has no boolean and vanishes."""
    text = F.concat(F.lit('{price:'), F.col("p_retailprice").cast("string"), F.lit(',big:'), F.when(F.col("p_size") % 3 == 0, '"maybe"').when(F.col("p_size") > 25, '"true"').otherwise("false"), F.lit("}"))
    return _decoded(spark, sf, "part", "p_partkey", C.record(price=C.Float, big=C.Bool), text, F.col("v.price").alias("price"), F.col("v.big").alias("big"))


@query("SELECT n_nationkey, n_name AS name FROM nation WHERE n_nationkey % 2 = 0")
def json_tuples_of_exact_arity(spark, sf):
    text = F.concat(F.lit('["'), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, '",null]').otherwise('",null,1]'))
    return _decoded(spark, sf, "nation", "n_nationkey", C.tuple_of(C.String, C.Unit), text, F.col("v._1").alias("name"))


@query("SELECT n_nationkey, n_regionkey::BIGINT AS region, n_name AS name FROM nation")
def json_mappings(spark, sf):
    as_object = F.concat(F.lit('{"'), F.col("n_regionkey").cast("string"), F.lit('":"'), F.col("n_name"), F.lit('"}'))
    as_pairs = F.concat(F.lit("[["), F.col("n_regionkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit('"]]'))
    text = F.when(F.col("n_nationkey") % 2 == 0, as_object).otherwise(as_pairs)
    got = read(spark, sf, "nation").select("n_nationkey", F.explode(C.json_decode(C.MapOf(C.String, C.Int), text)).alias("m"))
    return got.select("n_nationkey", F.explode("m").alias("region", "name"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Name' ELSE 'Key' END AS tag, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey END::BIGINT AS key FROM nation")
def json_variants(spark, sf):
    shape = C.SumOf((("Name", C.String), ("Key", C.Int)))
    key = F.col("n_nationkey").cast("long")
    value = F.when(key % 2 == 0, F.struct(F.lit("Name").alias("tag"), F.col("n_name").alias("Name"), F.lit(None).cast("long").alias("Key"))).otherwise(F.struct(F.lit("Key").alias("tag"), F.lit(None).cast("string").alias("Name"), key.alias("Key")))
    got = read(spark, sf, "nation").select("n_nationkey", F.explode(C.json_decode(shape, C.json_encode(shape, value))).alias("v"))
    return got.select("n_nationkey", "v.tag", F.col("v.Name").alias("name"), F.col("v.Key").alias("key"))


@query("SELECT n_nationkey, '{\"' || n_regionkey || '\":[\"' || n_name || '\",true]}' AS text FROM nation")
def json_encode_mapping(spark, sf):
    shape = C.MapOf(C.tuple_of(C.String, C.Bool), C.Int)
    pair = F.struct(F.col("n_name").alias("_1"), F.lit(True).alias("_2"))
    return read(spark, sf, "nation").select("n_nationkey", C.json_encode(shape, F.create_map(F.col("n_regionkey").cast("long"), pair)).alias("text"))


@query("SELECT n_nationkey, n_name AS name, [n_regionkey, 7]::BIGINT[] AS items FROM nation")
def marshal_roundtrip(spark, sf):
    shape = C.record(name=C.String, items=C.ListOf(C.Int))
    value = F.struct(F.col("n_name").alias("name"), F.array(F.col("n_regionkey").cast("long"), F.lit(7).cast("long")).alias("items"))
    got = read(spark, sf, "nation").select("n_nationkey", F.explode(C.marshal_decode(shape, C.marshal_encode(shape, value))).alias("v"))
    return got.select("n_nationkey", "v.name", "v.items")


@query("SELECT c_custkey, c_name AS name FROM customer WHERE c_custkey % 4 <> 3")
def encodings(spark, sf):
    """What doesn't decode gives an empty collection, so its row vanishes."""
    e = C.encoding("json", C.String)
    text = F.when(F.col("c_custkey") % 4 == 3, F.lit("{garbage")).otherwise(e.encode(F.col("c_name")))
    return read(spark, sf, "customer").select("c_custkey", F.explode(e.decode(text)).alias("name"))


# -- streams -----------------------------------------------------------------------------------------------------------------


def _through(spark, sf, f) -> DataFrame:
    columns = [F.col("event_id"), F.col("user_id"), F.col("event_type")]
    return _streamed(spark, lambda s, d: _source(s, d, "events", columns).through(f), sf)


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 3")
def stream_take(spark, sf):
    return _through(spark, sf, lambda df: S.take(df, "event_id", 3, ("user_id",)))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 3")
def stream_drop(spark, sf):
    return _through(spark, sf, lambda df: S.drop(df, "event_id", 3, ("user_id",)))


_BEFORE_SIGNUP = "SELECT event_id, user_id, event_type FROM (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n "


@query(_BEFORE_SIGNUP + "= 0")
def stream_take_while(spark, sf):
    return _through(spark, sf, lambda df: S.take_while(df, "event_id", lambda r: r.event_type != "signup", ("user_id",)))


@query(_BEFORE_SIGNUP + "> 0")
def stream_drop_while(spark, sf):
    return _through(spark, sf, lambda df: S.drop_while(df, "event_id", lambda r: r.event_type != "signup", ("user_id",)))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def stream_dedupe(spark, sf):
    return _through(spark, sf, lambda df: S.dedupe(df, "event_id", "event_type", ("user_id",)))


@query("SELECT count(DISTINCT event_type) AS kinds FROM events")
def stream_unique(spark, sf):
    got = _streamed(spark, lambda s, d: _source(s, d, "events", [F.col("event_type")]).unique("event_type"), sf)
    return got.agg(F.count("*").alias("kinds"))


@query("SELECT event_id, user_id, event_type, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM events")
def stream_rolling(spark, sf):
    return _through(spark, sf, lambda df: S.rolling(df, "event_id", 0, lambda s, r: s + int(r.event_id), "total long", ("user_id",)))


@query("SELECT event_id, step, event_type FROM (SELECT event_id, 1 AS step, event_type FROM events UNION ALL SELECT event_id, 0, '|' FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 1)")
def stream_interpose(spark, sf):
    return _through(spark, sf, lambda df: S.interpose(df, "event_id", "event_type", "|", ("user_id",)))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def stream_time_window(spark, sf):
    def build(s, d):
        return _source(s, d, "events", [F.col("ts").cast("timestamp").alias("ts")]).watermark("ts", "1 hour").group([F.window("ts", "1 hour").alias("w")], F.count("*").alias("n"))

    return _streamed(spark, build, sf).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS total FROM events")
def stream_reduce(spark, sf):
    return _streamed(spark, lambda s, d: _source(s, d, "events", [F.col("event_id")]).reduce(F.count("*").alias("n"), F.sum("event_id").alias("total")), sf)


@query("SELECT event_id, event_type || '!' AS loud FROM events WHERE event_type <> 'view'")
def stream_map_filter(spark, sf):
    def build(s, d):
        return _source(s, d, "events", [F.col("event_id"), F.col("event_type")]).filter(F.col("event_type") != "view").map("event_id", F.concat("event_type", F.lit("!")).alias("loud"))

    return _streamed(spark, build, sf)


# -- the language ---------------------------------------------------------------------------------------------------------------


def _program(spark, sf, program: str, **tables: str) -> DataFrame:
    """The plan of a program over tables (name=position column); the last definition is the result."""
    s = Session(stdlib=True, spark=spark)
    for name, pos in tables.items():
        s.table(name, read(spark, sf, name), pos)
    *definitions, last = [x.strip() for x in program.strip().split("\n\n")]
    for d in definitions:
        s._run(d)
    got = s.value(last)
    return got.pairs() if isinstance(got, Mapping) else got.df.select("item") if isinstance(got, Series) else spark.createDataFrame([(got,)], "item long" if isinstance(got, int) and not isinstance(got, bool) else "item boolean" if isinstance(got, bool) else "item string")


def _fields(df: DataFrame) -> DataFrame:
    return df.select("item.*")


@query("SELECT o_orderkey + o_custkey * 2 - 5 AS a, (o_orderkey - 100) // 7 AS q, (o_orderkey - 100) % 7 AS r FROM orders")
def lang_arithmetic(spark, sf):
    return _fields(_program(spark, sf, "map (o -> { a = o.o_orderkey + o.o_custkey * 2 - 5, q = (o.o_orderkey - 100) / 7, r = (o.o_orderkey - 100) mod 7 }) orders", orders="o_orderkey"))


@query("SELECT o_orderkey < o_custkey AS a, o_orderkey >= o_custkey AS b, (o_orderstatus = 'F' AND NOT o_custkey > 50) AS c, (o_orderkey <> 7 OR o_custkey = 7) AS d FROM orders")
def lang_comparison(spark, sf):
    program = 'map (o -> { a = o.o_orderkey < o.o_custkey, b = ge o.o_custkey o.o_orderkey, c = (o.o_orderstatus == "F") and not (o.o_custkey > 50), d = (o.o_orderkey != 7) or (eq 7 o.o_custkey) }) orders'
    return _fields(_program(spark, sf, program, orders="o_orderkey"))


@query("SELECT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END || '/' || p_brand AS item FROM part")
def lang_if_and_strings(spark, sf):
    return _program(spark, sf, 'map (p -> (if p.p_size > 25 then "big" else "small") ++ "/" ++ p.p_brand) part', part="p_partkey")


@query("SELECT w AS item FROM (SELECT unnest(regexp_extract_all(p_name, '[a-zA-Z]+')) AS w FROM part)")
def lang_words(spark, sf):
    return _program(spark, sf, "part |> flat_map (p -> string_words p.p_name)", part="p_partkey")


@query("SELECT n_nationkey::BIGINT AS nation, n_name AS name, n_nationkey * 10 + x AS place FROM nation, (SELECT unnest([1, 2]) AS x)")
def lang_comprehension(spark, sf):
    program = "pairs = ((n, x) -> { nation = n.n_nationkey, name = n.n_name, place = n.n_nationkey * 10 + x })\n\nnation |> unnest (n -> [1, 2]) |> map (p -> pairs (snd p, fst p))"
    return _fields(_program(spark, sf, program, nation="n_nationkey"))


@query("SELECT o_custkey AS k, sum(o_orderkey)::BIGINT AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def lang_group(spark, sf):
    program = "even = filter (o -> o.o_orderkey mod 2 == 0)\n\neven orders |> group (o -> o.o_custkey) (o -> o.o_orderkey) sum"
    return _program(spark, sf, program, orders="o_orderkey").toDF("k", "v")


@query("SELECT sum(o_orderkey) FILTER (o_orderkey % 3 = 0)::BIGINT AS item FROM orders")
def lang_filtering_reducer(spark, sf):
    return _program(spark, sf, "reduce (sum |> filtering (x -> x mod 3 == 0) |> mapping (o -> o.o_orderkey)) orders", orders="o_orderkey")


@query("SELECT count(*) AS item FROM orders WHERE o_orderstatus <> 'F'")
def lang_count_and_remove(spark, sf):
    return _program(spark, sf, 'orders |> remove (o -> o.o_orderstatus == "F") |> reduce count', orders="o_orderkey")


@query("SELECT bool_and(o_orderkey >= 0) AND NOT bool_or(o_custkey < 0) AND count(*) >= 10 AS item FROM orders")
def lang_quantifiers(spark, sf):
    return _program(spark, sf, "(forall (o -> o.o_orderkey >= 0) orders) and not (exists (o -> o.o_custkey < 0) orders) and (at_least 10 orders)", orders="o_orderkey")


@query("SELECT o_orderkey AS item FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 60) ORDER BY 1 OFFSET 10")
def lang_take_and_drop(spark, sf):
    return _program(spark, sf, "orders |> map (o -> o.o_orderkey) |> take 60 |> drop 10", orders="o_orderkey")


@query("SELECT sum(o_custkey) OVER (ORDER BY o_orderkey)::BIGINT AS item FROM orders")
def lang_rolling(spark, sf):
    return _program(spark, sf, "orders |> map (o -> o.o_custkey) |> rolling sum", orders="o_orderkey")


@query("SELECT count(*) OVER (ORDER BY o_orderkey) AS item FROM orders")
def lang_rolling_count(spark, sf):
    return _program(spark, sf, "rolling count orders", orders="o_orderkey")


@query("SELECT event_id // 100 AS k, count(*) AS v FROM events GROUP BY 1")
def lang_tumbling_window(spark, sf):
    return _program(spark, sf, "tumbling_window { size = 100, offset = 0 } (e -> e.event_id) count events", events="event_id").toDF("k", "v")


@query("SELECT event_id // 50 - s AS k, count(*) AS v FROM events, (SELECT unnest(range(0, 5)) AS s) GROUP BY 1")
def lang_sliding_windows(spark, sf):
    return _program(spark, sf, "sliding_windows { size = 200, slide = 50, offset = 0 } (e -> e.event_id) count events", events="event_id").toDF("k", "v")


@query("SELECT event_id // 50 - s AS item FROM events, (SELECT unnest(range(0, 5)) AS s)")
def lang_get_sliding_windows(spark, sf):
    return _program(spark, sf, "events |> flat_map (e -> get_sliding_windows { size = 200, slide = 50, offset = 0 } e.event_id)", events="event_id")


@query("SELECT n_nationkey AS k, coalesce(c, 0)::BIGINT AS customers, coalesce(s, 0)::BIGINT AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE c IS NOT NULL OR s IS NOT NULL")
def lang_cogroup(spark, sf):
    got = _program(spark, sf, "cogroup (c -> c.c_nationkey) (c -> c.c_custkey) (s -> s.s_nationkey) (s -> s.s_suppkey) customer supplier", customer="c_custkey", supplier="s_suppkey")
    k, v = got.columns
    return got.select(F.col(k).cast("int").alias("k"), F.size(f"{v}._1").cast("long").alias("customers"), F.size(f"{v}._2").cast("long").alias("suppliers"))


@query("SELECT n_nationkey AS k, coalesce(c, 0)::BIGINT AS customers, coalesce(s, 0)::BIGINT AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, sum(c_custkey) c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, sum(s_suppkey) s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE c IS NOT NULL OR s IS NOT NULL")
def lang_co_group(spark, sf):
    program = """
add_up = { zero = 0, unit = x -> x, plus = (+) }

co_group add_up add_up (map (c -> (c.c_nationkey, c.c_custkey)) customer) (map (s -> (s.s_nationkey, s.s_suppkey)) supplier)
"""
    got = _program(spark, sf, program, customer="c_custkey", supplier="s_suppkey")
    k, v = got.columns
    return got.select(F.col(k).cast("int").alias("k"), F.col(f"{v}._1").alias("customers"), F.col(f"{v}._2").alias("suppliers"))


@query("SELECT r_name || '/' || n_name AS item FROM region, nation")
def lang_cross_product(spark, sf):
    return _program(spark, sf, 'map_cross_product (r -> n -> r.r_name ++ "/" ++ n.n_name) region nation', region="r_regionkey", nation="n_nationkey")


@query("SELECT event_type AS item FROM (SELECT event_type, lag(event_type) OVER (ORDER BY event_id) AS p, event_id FROM events) WHERE p IS DISTINCT FROM event_type")
def lang_dedupe(spark, sf):
    return _program(spark, sf, "events |> map (e -> e.event_type) |> dedupe", events="event_id")


@query("SELECT DISTINCT event_type AS item FROM events")
def lang_unique(spark, sf):
    return _program(spark, sf, "events |> map (e -> e.event_type) |> unique", events="event_id")


@query("SELECT (props::JSON->>'$.k')::BIGINT AS item FROM events")
def lang_json_decode(spark, sf):
    return _program(spark, sf, "events |> flat_map (e -> json_decode :{ k: Int } e.props) |> map (.k)", events="event_id")


@query("SELECT '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS item FROM nation")
def lang_json_encode(spark, sf):
    return _program(spark, sf, "nation |> flat_map (n -> json_encode :{ id: Int, name: String } { id = n.n_nationkey, name = n.n_name })", nation="n_nationkey")


@query("SELECT n_name AS name, n_nationkey::BIGINT AS id, n_regionkey::BIGINT + 1 AS next FROM nation")
def lang_records_and_functions(spark, sf):
    program = """
with_next r = r with { next = r.region + 1 }

base n = { name = n.n_name, id = n.n_nationkey, region = n.n_regionkey }

nation |> map (base >> with_next) |> map (r -> { name = r.name, id = r.id, next = r.next })
"""
    return _fields(_program(spark, sf, program, nation="n_nationkey"))


@query("SELECT p_partkey AS a, p_size::BIGINT AS b FROM part WHERE p_size > 10")
def lang_pairs_and_patterns(spark, sf):
    program = "swapped = map swap\n\npart |> map (p -> (p.p_size, p.p_partkey)) |> filter ((s, k) -> s > 10) |> swapped"
    return _program(spark, sf, program, part="p_partkey").select(F.col("item._1").alias("a"), F.col("item._2").alias("b"))


@query("SELECT 5050 AS item")
def lang_lazy_generators(spark, sf):
    """An endless series that is cut, on the driver."""
    return _program(spark, sf, "reduce sum (take 100 (series 0 (add 1)))").select(F.col("item").cast("int").alias("item"))


@query("SELECT '[[], [1], [2], [1, 2]]' AS sets, '[[1, 2], [2, 3]]' AS windows, '[0, 1, 2, 9]' AS decorated, '\"positive\"' AS sign, '[1024]' AS power")
def lang_shown_values(spark, sf):
    s = Session(stdlib=True)
    shown = [s.run(p)[-1] for p in ("power_set [1,2]", "window_of 2 (1 .. 3)", "decorate 0 9 (1 ..< 3)", 'case (if 3 >= 0 then Pos(3) else Neg(3)) of { Pos(x) -> "positive", Neg(x) -> "negative" }', "[2 ** 10]")]
    return spark.createDataFrame([tuple(shown)], "sets string, windows string, decorated string, sign string, power string")


@query("SELECT o_custkey AS cust, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_by_key(spark, sf):
    s = Series(read(spark, sf, "orders").select(F.col("o_orderkey").alias("_pos"), F.struct("o_custkey", "o_totalprice").alias("item")), "item")
    return s.top(lambda x: x["o_custkey"], lambda x: x["o_totalprice"], 10).select(F.col("item.o_custkey").alias("cust"), "value")
