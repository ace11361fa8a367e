"""Every query of the core with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

from factloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in catalogue.ORACLES:
        want = duck.execute(f"select {', '.join(columns)} from ({catalogue.ORACLES[name]})").fetchall()
        assert rows == Counter(tuple(map(plain, r)) for r in want)
