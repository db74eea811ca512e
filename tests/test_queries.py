"""Every query against its SQL, on the smallest tables."""

import math
import os
from collections import Counter

import pytest

from codeloom.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DIRECTORY), reason="no test tables")
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in os.listdir(DIRECTORY):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DIRECTORY}/{name}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, database, name):
    frame = QUERIES[name](spark, DIRECTORY)
    columns = sorted(frame.columns)
    got = Counter(repr(plain(tuple(r))) for r in frame.select(*columns).collect())
    if name not in ORACLE:
        assert got or name.startswith("t")
        return
    result = database.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(repr(plain(tuple(row[i] for i in order))) for row in result.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
