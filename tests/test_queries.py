"""Every query of the core on the smallest tables, against its SQL where it has one."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from taleloom.plans import catalogue
from tools.compare import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


def agrees(spark, db, name, run, sql):
    frame = run(spark, SF)
    columns = sorted(frame.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if sql is None:
        return
    result = db.execute(sql)
    heads = [d[0] for d in result.description]
    assert sorted(heads) == columns
    assert rows == Counter(tuple(plain(r[heads.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, db, name):
    agrees(spark, db, name, catalogue.QUERIES[name], catalogue.SQL.get(name))


def test_sql_belongs_to_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
