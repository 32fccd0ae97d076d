"""Every registered query runs on the smallest tables and, where SQL says the same, gives the same rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemill import plans
from tidemill.registry import Registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(x):
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x) if x is not None and not isinstance(x, (bool, int)) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in plans.oracle_sql():
        assert df.columns
        return
    names = sorted(df.columns)
    result = duck.execute(plans.oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    theirs = [dict(zip(found, r)) for r in result.fetchall()]
    key = lambda r: tuple(repr(x) for x in r)
    assert sorted((tuple(plain(r[c]) for c in names) for r in rows), key=key) == sorted((tuple(plain(r[c]) for c in names) for r in theirs), key=key)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_registry_refuses_bad_operators():
    r = Registry()

    def fine(spark, sf_dir):
        """Says what it does."""

    def silent(spark, sf_dir):
        pass

    r.query()(fine)
    assert r.reads() == ["fine"]
    for bad in (fine, silent):
        with pytest.raises(ValueError):
            r.query()(bad)
