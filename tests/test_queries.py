"""Every core query against its SQL, over the smallest tables."""

import glob
import os
import math

import duckdb
import pytest

from tessera.plans.core_queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    df = QUERIES[name](spark, data)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    if name not in SQL:
        assert got
        return
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain(cursor.fetchall(), names)


def test_no_leftover_sql():
    assert set(SQL) <= set(QUERIES)
