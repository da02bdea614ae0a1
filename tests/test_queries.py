"""Every registered query of the library against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from wicker.queries import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF)):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=str)
    if name not in ORACLES:
        assert rows
        return
    result = duck.sql(ORACLES[name])
    order = [result.columns.index(c) for c in sorted(result.columns)]
    assert sorted(result.columns) == sorted(found.columns)
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
