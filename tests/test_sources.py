"""Sources of the language, paths, and the ingest server."""

import urllib.error
import urllib.request

from pyspark.sql import functions as F

from cairn.functions import keypaths as K
from cairn.lang.interpreter import Session
from cairn.sources import ingest, sinks, stores
from cairn.sources.keyvalue import KeyValue


def test_language_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two\nthree\n")
    KeyValue(spark, f"{tmp_path}/kv").write(spark.createDataFrame([("a", "1"), ("ab", "2"), ("b", "3")], "k string, v string"))
    s = Session(stdlib=True, spark=spark)
    assert s.run(f'file_lines "{tmp_path}/a.txt" |> flat_map string_words') == ['["one", "two", "three"]']
    assert s.run(f'(kyoto "{tmp_path}/kv").pairs_with_prefix "a"') == ['[("a", "1"), ("ab", "2")]']
    assert s.run(f'(kyoto "{tmp_path}/kv").values "b" |> flat_map (json_decode :Int)') == ["[3]"]
    assert s.run("cogroup fst snd fst snd [(1,2)] [(1,3),(2,4)] |> pairs") == ["[(1, [2], [3]), (2, [], [4])]"]
    assert s.run('r = { zero = 0, unit = id, plus = (+) }, pairs (co_group r r [("a",1),("a",2)] [("b",5)])')[-1] == '[("a", 3, 0), ("b", 0, 5)]'
    assert s.run("(encoding json :Int).decode \"12\"") == ["[12]"]


def test_language_reads_encoded_stores_and_words(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two\nthree 4\n")
    KeyValue(spark, f"{tmp_path}/kv").write(spark.createDataFrame([("a", "1"), ("ab", "x"), ("b", "3")], "k string, v string"))
    s = Session(stdlib=True, spark=spark)
    assert s.run(f'file_words "{tmp_path}/a.txt"') == ['["one", "two", "three"]']
    store = f'kyoto_encoded_as json.decode :Int "{tmp_path}/kv"'
    assert s.run(f'({store}).pairs, ({store}).values "b", ({store}).pairs_with_prefix "a"') == ['[[("a", 1)], [], [("b", 3)]]', "[3]", '[[("a", 1)], []]']


def test_key_value_updates_touch_their_buckets_and_batches_count_once(spark, tmp_path):
    kv = KeyValue(spark, f"file://{tmp_path}/kv", "long")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    got = lambda: {r.k: r.v for r in kv.pairs().collect()}
    assert got() == {}
    add = lambda old, new: old + new
    kv.fold_in(rows(("a", 1), ("b", 2)), add, 0)
    kv.fold_in(rows(("a", 1), ("b", 2)), add, 0)
    assert got() == {"a": 1, "b": 2}
    kv.fold_in(rows(("a", 5), ("c", 7)), add, 1)
    assert got() == {"a": 6, "b": 2, "c": 7} and [r.v for r in kv.get("a").collect()] == [6] and kv.get("z").count() == 0
    kv.update(spark.createDataFrame([("a", None, True), ("d", 4, False)], "k string, v long, removed boolean"))
    assert got() == {"b": 2, "c": 7, "d": 4}
    assert sorted(r.k for r in kv.pairs_within_range("b", "c").collect()) == ["b", "c"]
    held = kv._current()
    assert held["batch"] == 1 and len(set(held["buckets"].values())) > 1  # b's bucket is still the first version's
    kv.write(rows(("q", 1)))
    assert got() == {"q": 1}


def test_paths_of_a_store_are_read_back(spark):
    from cairn.sources.keyvalue import loaded_struct, stored_struct

    df = spark.createDataFrame([(1, "Ann", "x"), (2, "Bob", "y")], "id long, name string, tag string")
    entry = lambda path, v: F.struct(F.array(*map(F.lit, path)).alias("path"), v.alias("value"))
    stored = stored_struct(df, F.col("id"), F.array(entry(["name"], F.col("name")), entry(["tags", "0"], F.col("tag"))))
    assert sorted(map(tuple, loaded_struct(stored, ["name", "tags/0"]).collect())) == [("1", "Ann", "x"), ("2", "Bob", "y")]


def test_topics_go_on_behind_the_last_batch(spark, tmp_path):
    topic, seen = f"{tmp_path}/topic", []
    write = sinks.topic_logger(topic, F.col("value"))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")

    def drain():
        q = sinks.topic_stream(spark, topic).writeStream.foreachBatch(lambda df, _: seen.extend(r.value for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    write(rows("a", "b"), 0)
    drain()
    assert sorted(seen) == ["a", "b"]
    write(rows("c"), 1)
    drain()
    assert sorted(seen) == ["a", "b", "c"]


def test_stores(spark, tmp_path):
    a, b = stores.file_store(spark, f"file://{tmp_path}/a", {"n": 0}), stores.key_store(KeyValue(spark, f"file://{tmp_path}/kv"), "b", [])
    pair = stores.product(a, stores.combine(b, stores.unit(5)))
    assert pair.load() == ({"n": 0}, [[], 5])
    pair.save(({"n": 3}, [[1, 2], 9]))
    assert pair.load() == ({"n": 3}, [[1, 2], 5])
    copy = stores.file_store(spark, f"file://{tmp_path}/copy", None)
    stores.both(a.project(lambda s: s["n"], lambda n: {"n": n}), copy).save(8)
    assert a.load() == {"n": 8} and copy.load() == 8
    (tmp_path / "a").rename(tmp_path / "a.next")  # a save that was interrupted before its last step
    assert a.load() == {"n": 8}


def test_kafka_options():
    got = sinks.kafka_options("h:1", "t", partition=2)
    assert got["assign"] == '{"t":[2]}' and "subscribe" not in got and sinks.kafka_options("h:1", "t")["subscribe"] == "t"


def test_key_paths(spark):
    row = spark.range(1).select(F.array(F.lit("a"), F.lit("0")).alias("p"))
    of = lambda c: row.select(c.alias("c")).first()[0]
    assert of(K.next_index(F.col("p"))) == ["a", "1"] and of(K.first_index(F.col("p"))) == ["a", "0", "0"] and of(K.next_index(F.array(F.lit("x")))) is None
    assert of(K.extract_suffix(F.array(F.lit("a")), F.col("p"))) == ["0"] and of(K.extract_suffix(F.array(F.lit("b")), F.col("p"))) is None and of(K.root()) == []


def test_ingest(spark, tmp_path):
    s = ingest.server({"positions": ingest.landing(f"{tmp_path}/p")})
    try:
        url = f"http://127.0.0.1:{s.server_address[1]}"
        post = lambda path, body: urllib.request.urlopen(urllib.request.Request(f"{url}/{path}", body), timeout=10).status
        assert post("positions", b"hello") == 201
        try:
            post("other", b"x")
            raise AssertionError
        except urllib.error.HTTPError as e:
            assert e.code == 400
    finally:
        s.shutdown()
    out = []
    sinks.publisher(out.append, "value")(spark.read.text(f"{tmp_path}/p"), 0)
    assert out == ["hello"]
