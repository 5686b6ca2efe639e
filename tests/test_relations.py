"""Relations, conjunctive queries, multiplicities and ranges."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators import ranges as G
from cairn.operators import relation as L
from cairn.operators.mapping import Mapping


@pytest.fixture(scope="module")
def rel(spark):
    return L.Relation.of_table(spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12), (1, 10)], "a long, b long"), "a", "b")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_bag_semantics(spark, rel):
    x, y, z = L.var("x"), L.var("y"), L.var("z")
    assert rows(L.run(spark, [x, y], [L.Clause(x, rel, y)])) == [(1, 10), (1, 10), (1, 11), (2, 10), (3, 12)]
    assert rows(L.run(spark, [y], [L.Clause(L.value(1), rel, y)])) == [(10,), (10,), (11,)]
    assert rows(L.run(spark, [x], [L.Clause(x, rel, L.value(10))])) == [(1,), (1,), (2,)]
    # a filter keeps the records' own multiplicity
    assert rows(L.run(spark, [x, y], [L.Clause(x, rel, y), L.Clause(x, rel, y)])) == rows(L.run(spark, [x, y], [L.Clause(x, rel, y)]))
    back = rel.inverse()
    assert rows(L.run(spark, [x, z], [L.Clause(x, rel, y), L.Clause(y, back, z)])) == rows(rel.compose(back).pairs)
    assert rows(L.run(spark, [x], [L.Clause(x, rel, L.__)])) == [(1,), (1,), (1,), (2,), (3,)]


def test_computed_relations(spark, rel):
    x, y, z = L.var("x"), L.var("y"), L.var("z")
    twice = L.Relation.of_function(lambda v: v * 2, lambda v: v / 2)
    assert rows(L.run(spark, [x, z], [L.Clause(x, rel, y), L.Clause(x, twice, z), L.Clause(z, L.theta("gt"), L.value(3))])) == [(2, 4), (3, 6)]
    with pytest.raises(L.NoPlan):
        L.run(spark, [x, y], [L.Clause(x, L.theta("lt"), y)])
    with pytest.raises(L.Unbounded):
        L.run(spark, [z], [L.Clause(x, rel, y)])


def test_multiplicity(rel):
    assert L.ONE * L.SOME == L.SOME and L.OPTIONAL * L.SOME == L.ANY and L.ONE * L.ONE == L.ONE
    one = L.Relation(rel.pairs, forward=L.ONE, backward=L.SOME)
    x, y = L.var("x"), L.var("y")
    p = L.plan([L.Clause(L.value(1), one, x), L.Clause(x, L.theta("eq"), y)])
    assert [how for how, _ in p.steps] == ["map", "map"] and p.multiplicity == L.ONE
    assert L.plan([L.Clause(L.value(1), one, x), L.Clause(x, L.theta("lt"), L.value(3))]).multiplicity == L.OPTIONAL


exprs = st.recursive(st.builds(G.Half, st.sampled_from(["EQ", "NE", "LT", "LE", "GT", "GE"]), st.integers(0, 6)) | st.sampled_from([G.EMPTY, G.FULL]), lambda e: st.builds(G.And, e, e) | st.builds(G.Or, e, e) | st.builds(G.Not, e), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(exprs)
def test_range_normal_forms(e):
    parts = G.intervals(e)
    for v in [x / 2 for x in range(-2, 16)]:
        want = G.contain(e, v)
        assert any(all(h.holds(v) for h in c) for c in G.dnf(e)) == want == any(i.contains(v) for i in parts)
    for a, b in itertools.pairwise(parts):
        assert not G.overlap(a, b) and a.high is not None and b.low is not None and a.high[0] <= b.low[0] and not (a.high[0] == b.low[0] and (a.high[1] or b.low[1]))


def test_range_column_is_pushed(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/r")
    df = spark.read.parquet(f"{tmp_path}/r").where(G.column(G.Not(G.between(5, 90)), F.col("id")))
    assert df.count() == 14 and "LessThan(id,5)" in df._jdf.queryExecution().toString()


def test_mapping(spark):
    m = Mapping(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, value long"))
    staged = m.replace(spark.createDataFrame([("b", 20), ("d", 4)], "key string, value long")).remove(spark.createDataFrame([("a",)], "key string"))
    assert rows(staged.pairs()) == [("b", 20), ("c", 3), ("d", 4)] and rows(staged.rollback_updates().pairs()) == rows(m.pairs())
    assert rows(staged.commit_updates().get("d")) == [(4,)] and rows(m.get("z")) == []
    again = staged.replace(spark.createDataFrame([("a", 7)], "key string, value long"))
    assert rows(again.get("a")) == [(7,)] and rows(again.keys()) == [("a",), ("b",), ("c",), ("d",)]
    more = m.update_with(spark.createDataFrame([("a", 5), ("e", 9)], "key string, value long"), lambda old, new: old + new)
    assert rows(more.pairs()) == [("a", 6), ("b", 2), ("c", 3), ("e", 9)]
    assert m.equal(m).first()[0] and not m.equal(staged).first()[0]
