"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from gaugeleaf.plans import catalog
from gaugeleaf.sources.domain import BASE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, database, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = database.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in row) for row in result.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in got) == want
