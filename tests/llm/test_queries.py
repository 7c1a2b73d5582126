"""The queries that have SQL agree with it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tertulia.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    theirs = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(map(tuple, theirs), key=repr) and theirs


@pytest.mark.parametrize(("number", "dealt"), [(6, "p6_ids"), (7, "p7_mix")])
def test_dealt_problem_is_the_first_of_its_number(number, dealt):
    own = [x for x in queries.QUERIES if x.startswith(f"p{number}_")]
    assert own[0] == min(own) == dealt
