"""Queries that SQL can express, against DuckDB over the whole tables."""

import os

import duckdb
import pytest

from loanloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{SF_DIR}/{file}'")
    wanted = con.execute(ORACLES[name])
    columns = [d[0] for d in wanted.description]
    found = QUERIES[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(columns)
    got = sorted(map(tuple, found.select(*columns).collect()))
    assert len(got) > 0 and got == sorted(wanted.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
