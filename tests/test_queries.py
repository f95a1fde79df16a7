"""Every query that has SQL against that SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from stemma.plans import fields, manifests, places, problems  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return float(f"{value:.9g}") if isinstance(value, float) else value


def compare(spark, query, sql, folder=FOLDER):
    """The same columns and, in any order, the same rows."""
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for file in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(file).removesuffix('.parquet')} as select * from read_parquet('{file}')")
    other = con.sql(sql)
    got = query(spark, folder)
    columns = sorted(got.columns)
    assert columns == sorted(other.columns)
    at = [other.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)


@pytest.mark.parametrize("module, name", [(m, n) for m in (problems, manifests) for n in m.SQL])
def test_against_sql(spark, module, name):
    compare(spark, module.QUERIES[name], module.SQL[name])
