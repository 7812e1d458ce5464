"""Every query of the catalogue that SQL can say, against DuckDB on the driver's smallest tables."""

import os

import pytest

from souk.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(oracles.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(_rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    b = sorted((tuple(_rounded(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_all_queries_have_an_oracle_but_the_generators():
    assert set(catalog.QUERIES) - set(oracles.ORACLES) == {"gen_delivery_events", "gen_clickstream"}
