"""Every catalogue query against its SQL."""

import os
from collections import Counter

import duckdb
import pytest

from textloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    query, sql = catalogue.QUERIES[name]
    found = query(spark, SF)
    columns = sorted(found.columns)
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == Counter(rows)
