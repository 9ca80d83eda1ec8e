"""Every registered query at the smallest scale, against its SQL where it has some."""

import datetime
import decimal
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from folioframe.plans.catalog import REGISTRY  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, duck, name):
    df = REGISTRY.queries[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((str([plain(r[c]) for c in columns]) for r in df.collect()))
    if name not in REGISTRY.sql:
        return
    got = duck.execute(REGISTRY.sql[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = sorted(str([plain(x[names.index(c)]) for c in columns]) for x in got.fetchall())
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
