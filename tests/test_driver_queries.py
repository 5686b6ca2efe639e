"""Every registered query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

from cairn.plans import operator_queries  # noqa: F401  (registers its queries)
from cairn.plans.driver_queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows):
    fix = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*names).collect()]
    want = db.execute(ORACLE[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == names
    order = [cols.index(n) for n in names]
    assert norm(rows) == norm([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", ["json_int_from_text", "json_floats_and_bools", "json_decode_props", "json_roundtrip"])
def test_json_is_decoded_on_all_cores(spark, name):
    """A small file is one partition; decoding its rows is dealt over the cores."""
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
