"""Every query of the engine's own operators against its DuckDB twin, on a small table set."""

import datetime
import math
import os

import duckdb
import pytest

from gaugeworks.plans import catalogue
from gaugeworks.plans.dual import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, (bool, str, datetime.date)):
        return str(v)
    f = float(v)
    return "nan" if math.isnan(f) else f"{f:.6g}"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in catalogue.SQL:
        assert got
        return
    cur = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
