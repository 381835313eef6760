"""Every registered core query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from quillspark.plans import fixtures, queries

SF = "/root/testdata/sf0.001"
assert fixtures


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    made.execute("set timezone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        made.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return made


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = db.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns and mine == theirs
