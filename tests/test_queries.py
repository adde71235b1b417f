import collections
import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.queries() if n.startswith("q_"))


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in entry.oracle_sql():
        cursor = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
