"""The driver's contract for this subpackage's queries."""

import math

import duckdb
import pytest

SF = "/root/testdata/sf0.01"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert [k for k in range(1, 11) if not any(n.startswith(f"op{k}_") for n in names)] == [] and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_nearest", "op7_near_duplicates", "op9_decontaminate", "pii_base_spans", "katz_counts"])
def test_query_against_sql(spark, name):
    from cairn.llm import queries

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    close = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    rows = lambda rs: sorted((tuple(map(close, r)) for r in rs), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())
