"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from cargolens import plans
from cargolens.plans.facts import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = plans.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no benchmark tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    if name not in SQL:
        assert got
        return
    result = duck.sql(SQL[name])
    names = list(result.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted([tuple(plain(r[i]) for i in at) for r in result.fetchall()], key=repr)
    assert got == expected
