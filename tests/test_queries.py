"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def twin(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].removesuffix("T00:00:00")
    try:
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, folder, twin, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = twin.execute(ORACLE_SQL[name])
    at = [c[0] for c in found.description]
    assert sorted(at) == columns
    assert got == sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", ["d15_approx_distinct", "d17_sketch_rollup"])
def test_sketch_error(spark, folder, name):
    assert all(r.error < 0.1 for r in QUERIES[name](spark, folder).collect())
