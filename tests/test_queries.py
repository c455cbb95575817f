"""Every query of the library against its SQL at the smallest size."""

import glob
import math
import os

import duckdb
import pytest

from foliant.plans.all import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, name, query, sql, sf=SF):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = query(spark, sf)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    return rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    compare(spark, name, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    assert __spark_entry__.entry(spark).count() == 30
    assert set(QUERIES) <= set(__spark_entry__.queries())
