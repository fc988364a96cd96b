"""Every query with SQL against it, on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from quire.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
#: A part of the catalogue, so that the tests stay short; the driver checks all of it.
NAMES = sorted(catalog.QUERIES)[::4]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in catalog.ORACLE:
        cur = db.execute(catalog.ORACLE[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        assert rows == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
