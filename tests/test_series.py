"""The ordered operators, over tables and over arrays, against the expected items."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import arrays as A
from cairn.functions import reducer as R
from cairn.operators.series import Series


def items(s):
    return [r[0] for r in s.df.orderBy(s.pos).select(s.item).collect()]


@pytest.fixture(scope="module")
def dup(spark):
    return Series.of_list(spark, [1, 2, 2, 3, 2, 1, 3], "long")


def test_generators(spark):
    assert items(Series.range(spark, 1, 5)) == [1, 2, 3, 4, 5] and items(Series.range(spark, 5, 1)) == []
    assert items(Series.repeat(spark, 3, F.lit(7))) == [7, 7, 7]
    assert items(Series.iterate(spark, 4, lambda x: x + 9, F.lit(0).cast("long"))) == [0, 9, 18, 27]
    assert items(Series.empty(spark, "long")) == [] and items(Series.singleton(spark, 3, "long")) == [3] and items(Series.of_option(spark, None, "long")) == []


def test_prefixes(spark):
    s = Series.range(spark, 1, 10)
    assert items(s.take(2)) == [1, 2] and items(s.drop(8)) == [9, 10] and items(s.take(0)) == []
    assert items(s.take_while(lambda x: x < 4)) == [1, 2, 3] and items(s.drop_while(lambda x: x < 8)) == [8, 9, 10]
    assert items(s.take_while(lambda x: x > 0)) == list(range(1, 11)) and items(s.drop_while(lambda x: x > 0)) == []
    assert items(s.take_first()) == [1] and items(s.take_last()) == [10]
    assert items(Series.of_list(spark, ["a", "b", "c"], "string").take_no_more_than(2, F.lit("..."))) == ["a", "b", "..."]


def test_neighbours(spark, dup):
    assert items(dup.unique()) == [1, 2, 3] and items(dup.dedupe()) == [1, 2, 3, 2, 1, 3]
    three = Series.of_list(spark, [1, 2, 3], "long")
    assert items(three.interpose(F.lit(0).cast("long"))) == [1, 0, 2, 0, 3]
    assert items(three.before_each(F.lit(0).cast("long"))) == [0, 1, 0, 2, 0, 3] and items(three.after_each(F.lit(0).cast("long"))) == [1, 0, 2, 0, 3, 0]
    assert items(three.cons(F.lit(9))) == [9, 1, 2, 3] and items(three.sonc(F.lit(9))) == [1, 2, 3, 9]
    assert items(three.decorate(F.lit(7), F.lit(8))) == [7, 1, 2, 3, 8]
    assert items(three.append(dup).drop(2).dedupe()) == [3, 1, 2, 3, 2, 1, 3] and items(three.union(dup)) == [1, 2, 3]
    nulls = Series.of_list(spark, [None, None, 1, None], "long")
    assert items(nulls.dedupe()) == [None, 1, None] and items(nulls.unique()) == [None, 1]


def test_flattening(spark):
    s = Series.range(spark, 1, 3)
    assert items(s.flat_map(lambda x: A.range_(F.lit(1).cast("long"), x))) == [1, 1, 2, 1, 2, 3]
    pairs = s.unnest(lambda x: F.array(x, x * 10))
    assert [tuple(r) for r in pairs.df.orderBy("_pos").select("item", "parent").collect()] == [(1, 1), (10, 1), (2, 2), (20, 2), (3, 3), (30, 3)]
    assert items(s.map(lambda x: x * 2).filter(lambda x: x > 2)) == [4, 6] and items(s.remove(lambda x: x == 2)) == [1, 3]
    assert items(s.filter_map(lambda x: F.when(x > 1, x))) == [2, 3]


def test_against_lists(spark):
    """Many ranges of positions: sums, numbers, runs and windows agree with plain Python."""
    r = random.Random(3)
    xs = [r.randrange(4) for _ in range(3000)]
    s = Series(spark.createDataFrame([(7 * i, x) for i, x in enumerate(xs)], "_pos long, item long").repartition(5), "item")
    sums = [q[0] for q in s.rolling_sum().df.orderBy("_pos").select("rolled").collect()]
    assert sums == [sum(xs[: i + 1]) for i in range(len(xs))]
    assert items(s.dedupe()) == [x for i, x in enumerate(xs) if i == 0 or xs[i - 1] != x]
    assert items(s.drop(2990)) == xs[2990:]
    w = [q[0] for q in s.windows_of(4).df.orderBy("_pos").select("window").collect()]
    assert w == [xs[i : i + 4] for i in range(len(xs) - 3)]
    assert s.windows_of(5000).df.count() == 0


def test_results(spark, dup):
    one = lambda df: df.first()[0]
    assert one(dup.length()) == 7 and one(dup.forall(lambda x: x > 0)) and not one(dup.exists(lambda x: x > 3))
    none = Series.empty(spark, "long")
    assert one(none.is_empty()) and not one(dup.is_empty()) and one(none.forall(lambda x: x > 0)) and not one(none.exists(lambda x: x > 0))
    assert one(dup.equal(dup)) and not one(dup.equal(dup.take(3))) and one(none.equal(none))
    assert dup.show() == "[1; 2; 2; 3; 2; 1; 3]" and dup.show("[", ", ", "]", 2) == "[1, 2, ...]"
    assert one(dup.at_least(7)) and not one(dup.at_least(8)) and one(dup.at_most(7)) and one(dup.count_at_most(3)) == 3
    assert one(dup.reduce(R.sum_())) == 14 and one(none.reduce(R.sum_())) == 0


def test_top(spark):
    rows = lambda ps: Series(spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "_pos long, item struct<k: long, v: long>"), "item")
    top = lambda ps, n=2: [tuple(r[0]) for r in rows(ps).top(lambda x: x["k"], lambda x: x["v"], n).collect()]
    assert top([(1, 2), (4, 9), (1, 3), (8, 19)]) == [(8, 19), (4, 9)]
    assert top([(1, 2), (1, 3)]) == [(1, 3)] == top([(1, 3), (1, 2)]) and top([(1, 3), (2, 1), (1, 2)]) == [(1, 3), (2, 1)]
    assert top([(1, 5), (2, 5), (3, 5)]) == [(1, 5), (2, 5)] and top([(1, 5)], 0) == []


def test_transduce(spark):
    s = Series.range(spark, 0, 9)
    got = s.transduce([], lambda st, r: ([r.item, *st], []), lambda st: [(x,) for x in st], "x long")
    assert [r[0] for r in got.collect()] == list(range(9, -1, -1))


def test_arrays(spark):
    row = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in (1, 2, 2, 3, 2, 1, 3)]).alias("xs"))
    of = lambda c: row.select(c.alias("c")).first()[0]
    xs = F.col("xs")
    assert of(A.dedupe(xs)) == [1, 2, 3, 2, 1, 3] and of(A.unique(xs)) == [1, 2, 3]
    assert of(A.take_while(xs, lambda x: x < 3)) == [1, 2, 2] and of(A.drop_while(xs, lambda x: x < 3)) == [3, 2, 1, 3]
    assert of(A.interpose(A.take(xs, 3), F.lit(0).cast("long"))) == [1, 0, 2, 0, 2] and of(A.drop(xs, 5)) == [1, 3] and of(A.drop(xs, 50)) == []
    assert of(A.windows_of(A.take(xs, 4), 3)) == [[1, 2, 2], [2, 2, 3]] and of(A.windows_of(A.take(xs, 2), 3)) == []
    assert of(A.power_set(A.take(xs, 2))) == [[], [1], [2], [1, 2]] and of(A.power(F.lit(3), F.lit(4))) == 81
    assert of(A.range_(F.lit(5), F.lit(1))) == [] and of(A.bounded_generate(F.lit(0), lambda s: (s + 1, s * s), lambda s: s >= 4, 10)) == [0, 1, 4, 9]
    split = lambda t, r: of(A.string_split(F.lit(t), r))
    assert split("a,b,c", ",") == ["a", "b", "c"] and split("a,,,c", ",") == ["a", "", "", "c"] and split("a,,,c", ",+") == ["a", "c"]
    assert split(",a,", ",") == ["a"] and split("", ",") == []


def test_reducers_over_arrays_and_rows_agree(spark):
    df = spark.createDataFrame([(i, i % 3, i * i % 7) for i in range(20)], "p long, k long, x long")
    rs = {"sum": R.sum_(), "product": R.product_().mapping(lambda x: x + 1), "count": R.count(), "first": R.first(), "last": R.last_or(F.lit(0)), "set": R.set_(), "list": R.list_(), "odd": R.sum_().filtering(lambda x: x % 2 == 1), "twice": R.list_().flat_mapping(lambda x: F.array(x, x)), "even": R.and_().mapping(lambda x: x % 2 == 0), "fold": R.fold(F.lit(1).cast("bigint"), lambda a, x: (a * 31 + x) % 1009), "text": R.show().mapping(lambda x: x.cast("string")), "void": R.void(F.lit(4)), "capped": R.monoid_with_maximum(F.lit(0).cast("bigint"), lambda a, x: F.least(a + x, F.lit(9).cast("bigint")), lambda a: a == 9)}
    rows = df.groupBy("k").agg(*[r.over_rows(F.col("x"), F.col("p")).alias(n) for n, r in rs.items()])
    arrays = df.groupBy("k").agg(R.list_().over_rows(F.col("x"), F.col("p")).alias("xs")).select("k", *[r.over_array(F.col("xs")).alias(n) for n, r in rs.items()])
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, arrays.collect()))


def test_signed_bag(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", -1), ("c", 2)], "_1 string, _2 long")
    assert df.agg(R.signed_bag().over_rows(F.struct("_1", "_2"), F.lit(0)).alias("b")).first()[0] == {"b": 1, "c": 2}
