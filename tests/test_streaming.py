"""Streams: the room fixture, batch and stream agree, restarts go on, sinks and stores."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import codecs as C
from cairn.sources import files, sinks
from cairn.sources.keyvalue import KeyValue, stored_struct
from cairn.streaming import apps, changelog
from cairn.streaming.incremental import Producer

POSITIONS = [("V001", "R065", 1234567), ("V001", "R065", 1234667), ("V002", "R064", 1234668), ("V002", "R065", 1234768), ("V002", "R065", 1234868), ("V002", "R065", 1234968), ("V002", "R066", 1235168)]
MOVES = [("V001", 1, "R065"), ("V002", 1, "R064"), ("V002", -1, "R064"), ("V002", 1, "R065"), ("V002", -1, "R065"), ("V002", 1, "R066")]


@pytest.fixture(scope="module")
def positions(spark):
    lines = [f'{{"visitor":"{v}","room":"{r}","timestamp":{t}}}' for v, r, t in POSITIONS] + ["", "not json", '{"visitor":"V9"}']
    return apps.decode_positions(spark.createDataFrame(list(enumerate(lines)), "n long, value string"))


def test_room_moves_and_counts(positions):
    moves = apps.room_moves(positions, "n")
    assert [(r.key, r.sign, r.value) for r in moves.orderBy("pos", "step").collect()] == MOVES
    counts = [(r.value, r["count"]) for r in apps.room_counts(moves).orderBy("pos", "step").collect()]
    assert counts == [("R065", 1), ("R064", 1), ("R064", 0), ("R065", 2), ("R065", 1), ("R066", 1)]


def test_seeds_and_returns(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 5), (3, "a", -5), (4, "a", 0), (5, "b", 0)], "n long, k string, d long")
    got = changelog.group_updates(df, "k", "n", lambda: F.sum("d"), F.lit(0))
    assert [(r.pos, r.sign, r.value) for r in got.orderBy("pos", "step").collect()] == [(2, 1, 5), (3, -1, 5), (3, 1, 0)]


def test_message_texts(spark):
    row = spark.range(1).select(apps.encode_move(F.lit(-1), F.lit("V1"), F.lit("R2")).alias("m"), apps.encode_count(F.lit("R1"), F.lit(3)).alias("c"))
    assert tuple(row.first()) == ("- {V1,R2}", '{ "room": "R1", "count": 3 }')
    assert tuple(row.select(apps.decode_move(F.col("m")).alias("d")).first()[0]) == (-1, "V1", "R2")


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{n}" for n in ("src", "out", "check"))
    schema = "n long, visitor string, room string"
    rows = [(i, v, r) for i, (v, r, _) in enumerate(POSITIONS)]

    def write(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/b{batch}")

    for part in (rows[:3], rows[3:5], rows[5:]):
        _write(spark, src, part, schema)
        # a new query each time: state and offsets come from the checkpoint
        Producer.files(spark, src, schema).through(lambda df: apps.room_moves_stream(df, "n")).log(write).run(check)
    got = spark.read.parquet(f"{out}/b*")
    assert [(r.key, r.sign, r.value) for r in got.orderBy("pos", "step").collect()] == MOVES


@pytest.mark.parametrize("name,expect", [("take", [1, 2, 2]), ("drop", [3, 2, 1, 3]), ("take_while", [1, 2, 2]), ("drop_while", [3, 2, 1, 3]), ("dedupe", [1, 2, 3, 2, 1, 3]), ("rolling", [1, 3, 5, 8, 10, 11, 14])])
def test_stateful_series(spark, tmp_path, name, expect):
    ops = {
        "take": lambda df: changelog.take(df, "n", 3),
        "drop": lambda df: changelog.drop(df, "n", 3),
        "take_while": lambda df: changelog.take_while(df, "n", lambda r: r.x < 3),
        "drop_while": lambda df: changelog.drop_while(df, "n", lambda r: r.x < 3),
        "dedupe": lambda df: changelog.dedupe(df, "n", "x"),
        "rolling": lambda df: changelog.rolling(df, "n", 0, lambda s, r: s + r.x, "sum long"),
    }
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    xs = list(enumerate([1, 2, 2, 3, 2, 1, 3]))
    for part in (xs[:2], xs[2:5], xs[5:]):
        _write(spark, src, part, "n long, x long")
        Producer.files(spark, src, "n long, x long").through(ops[name]).log(lambda df, b: df.write.mode("overwrite").parquet(f"{out}/b{b}")).run(f"{tmp_path}/check")
    got = spark.read.parquet(f"{out}/b*").orderBy("n")
    assert [r[-1] for r in got.collect()] == expect


def test_sinks_and_views(spark, tmp_path, capsys):
    src = f"{tmp_path}/src"
    _write(spark, src, [(0, "a b a"), (1, "xxx"), (2, "b a")], "n long, value string")
    texts = Producer.files(spark, src, "n long, value string")
    apps.top_words(apps.without_spam(texts), 1).log(sinks.file_view(f"{tmp_path}/view"), sinks.console_logger("word")).run(f"{tmp_path}/c1")
    assert [r.k for r in KeyValue(spark, f"{tmp_path}/view").pairs().collect()] == ["a"] and capsys.readouterr().out.strip() == "a"
    with pytest.raises(ValueError):
        apps.without_spam(texts.log(sinks.file_logger(f"{tmp_path}/log", "value")))
    df = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "resource string, value long")
    sinks.routed({"p": sinks.file_logger(f"{tmp_path}/p", "value"), "*": sinks.topic_logger(f"{tmp_path}/t", F.col("value"))})(df, 0)
    assert [r[0] for r in spark.read.text(f"{tmp_path}/p").select("value").collect()] == ["1"] and sorted(r.value for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["2", "3"]
    assert sinks.kafka_options("s:1", "t", 2)["assign"] == '{"t":[2]}'


def test_key_value(spark, tmp_path):
    kv = KeyValue(spark, f"{tmp_path}/kv")
    assert kv.pairs().count() == 0
    kv.write(spark.createDataFrame([("a", "1"), ("ab", "2"), ("b", "3")], "k string, v string"))
    kv.update(spark.createDataFrame([("b", None, True), ("c", "4", False)], "k string, v string, removed boolean"))
    of = lambda df: sorted(tuple(r) for r in df.collect())
    assert of(kv.pairs()) == [("a", "1"), ("ab", "2"), ("c", "4")] and of(kv.get("ab")) == [("2",)]
    assert of(kv.pairs_with_prefix("a")) == [("a", "1"), ("ab", "2")] and of(kv.pairs_within_range("ab", "c")) == [("ab", "2"), ("c", "4")]
    typed = KeyValue(spark, f"{tmp_path}/kv", encoding=C.encoding("json", C.Int))
    assert of(typed.decoded()) == [("a", 1), ("ab", 2), ("c", 4)]


def test_json_outside_of_the_standard(spark):
    """Repeated fields, unquoted names, strings that look like either, mappings from pairs."""

    def decoded(shape, *texts):
        d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [[x.asDict() if hasattr(x, "asDict") else x for x in r[0]] for r in d.select(C.json_decode(shape, F.col("t")), "i").orderBy("i").collect()]

    k, a = C.record(k=C.Int), C.record(a=C.String)
    assert decoded(k, '{"k":1,"k":2}', "{k:1}", '{"j":{"k":3},"k":1}', '{"k":1,"j":{"a":1,"a":2},"k":[2,{"k":3}],"j":4}', '{"k":[1]}', "{") == [[{"k": 1}]] * 4 + [[], []]
    assert decoded(a, '{a:"x, b: y"}', '{ a : "q\\"x:", "b" : 2}', '{a:"x",a:"y"}', '{"a":"1","b":{"a":"2"}}') == [[{"a": v}] for v in ("x, b: y", 'q"x:', "x", "1")]
    assert decoded(C.MapOf(C.Int), '{"a":1,"b":2}', '[["a",1],["b",2],["a",3]]', '{"a":"x"}', "{}", "[]") == [[{"a": 1, "b": 2}], [{"a": 1, "b": 2}], [], [{}], [{}]]
    assert decoded(C.MapOf(C.String, C.Int), '{"1":"x"}', '[[1,"x"],[2,"y"]]', '{"z":"x"}') == [[{1: "x"}], [{1: "x", 2: "y"}], []]


def test_repaired_json(spark):
    """Repeated fields at any depth, in lists, with signs in strings, and in long texts."""

    def repaired(*texts):
        d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r[0] for r in d.select(C._repaired(F.col("t")), "i").orderBy("i").collect()]

    assert repaired('{"n":"3","more":[1,{}],"n":7}', '{a:{a:1,"a":2},"a":[{a:3}], b : [ {c:1,c:[2,{c:3}]}, "c:" ]}', '{"k":"},{","k":"x","l":[],"l":[1]}') == ['{"n":"3","more":[1,{}]}', '{"a":{"a":1},"b":[{"c":1},"c:"]}', '{"k":"},{","l":[]}']
    long = ",".join(f'"{k}, k:"' for k in range(20000))
    assert repaired(f'{{k:[{long}],k:[{long}],j:"{"x" * 200000}"}}') == [f'{{"k":[{long}],"j":"{"x" * 200000}"}}']
    # a list of values without names is one piece
    assert spark.sql("SELECT 1").select(F.size(F.regexp_extract_all(F.lit('{"n":"3","more":[1,{}],"n":7}'), F.lit(C._PIECE), F.lit(0)))).first()[0] == 5


def test_codecs(spark):
    shape = C.parse_shape("{ x: Int, y: (String, Bool), z: [Int] }")
    good = '{"x":"12","y":["a","true"],"z":[1,2],"more":0}'
    texts = [good, "{x:1,y:[\"q\",false],z:[]}", '{"x":1}', "garbage", '{"x":1.5,"y":["a",true],"z":[]}', '{"x":1,"y":["a"],"z":[]}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = df.select("n", F.explode(C.json_decode(shape, F.col("t"))).alias("v")).orderBy("n")
    assert [(r.n, r.v.x, tuple(r.v.y), r.v.z) for r in got.collect()] == [(0, 12, ("a", True), [1, 2]), (1, 1, ("q", False), [])]
    back = got.select(C.json_encode(shape, F.col("v")).alias("j"), F.explode(C.marshal_decode(shape, C.marshal_encode(shape, F.col("v")))).alias("w"), "v")
    assert [r.j for r in back.collect()][0] == '{"x":12,"y":["a",true],"z":[1,2]}' and all(r.v == r.w for r in back.collect())
    flat = stored_struct(got.where("n = 0"), F.lit("k"), C.key_paths(shape, F.col("v")))
    assert sorted(tuple(r) for r in flat.collect()) == [("k/x", "12"), ("k/y/0", '"a"'), ("k/y/1", "true"), ("k/z/0", "1"), ("k/z/1", "2")]
    m = C.MapOf(C.Int)
    assert spark.range(1).select(C.json_decode(m, F.lit('{"a":1,"b":2}'))[0].alias("m")).first()[0] == {"a": 1, "b": 2}
    s = C.SumOf((("Pos", C.Int), ("Neg", C.String)))
    v = spark.range(1).select(C.json_decode(s, F.lit('["Pos",3]'))[0].alias("s"))
    assert tuple(v.first()[0]) == ("Pos", 3, None) and v.select(C.json_encode(s, F.col("s"))).first()[0] == '["Pos",3]'


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one two\n\nthree4five\n")
    (tmp_path / "b.bin").write_bytes(b"x" * 2500)
    assert files.files(spark, str(tmp_path)).count() == 2
    assert [r.value for r in files.file_lines(spark, f"{tmp_path}/d").collect()] == ["one two", "", "three4five"]
    assert sorted(r.word for r in files.words(files.file_lines(spark, f"{tmp_path}/d")).collect()) == ["five", "one", "three", "two"]
    assert [len(r.chunk) for r in files.file_chunks(spark, f"{tmp_path}/b.bin").orderBy("chunk_no").collect()] == [1024, 1024, 452]
    assert files.positions(spark, 50).where("visitor RLIKE '^V[0-9]{3}$' AND room RLIKE '^R[0-3][.][0-4]$'").count() == 50
