"""Every registered query of the base library against its SQL on the small tables."""

import os

import duckdb
import pytest

from siftworks.plans import imports, queries, semantics  # noqa: F401
from siftworks.plans.registry import ORACLE, QUERIES


def normal(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got
    if name not in ORACLE:
        return
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{file}')")
    want = con.sql(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    assert normal(got) == normal(want)
