"""Every registered query of the library against its SQL, run by another engine over the same tables."""

import duckdb
import pytest

from penstroke import plans

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "conversations", "benchmark", "labels", "pages"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert plans.QUERIES.keys() == plans.SQL.keys()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    result = duck.execute(plans.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr([row[names.index(c)] for c in df.columns]) for row in result.fetchall())
    assert sorted(repr(list(r)) for r in df.collect()) == want
