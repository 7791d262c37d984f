"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os
from glob import glob

import duckdb
import pytest

from citeloom.operators import graph
from citeloom.plans import catalogue, exchange  # noqa: F401  exchange adds its queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def same(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(same, r))) for r in df.select(*cols).collect())
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(same(r[names.index(c)]) for c in cols)) for r in found.fetchall())
    assert got == want


def test_known_hops(spark):
    """Five seeds have 17 neighbours, and these 437, of which five are the seeds."""
    e = catalogue.edges(spark, DATA)
    seeds = e.where("ord < 500000000").select(e.src.alias("node"))
    hops = {r["hop"]: r["count"] for r in graph.expand(e, catalogue.reverse(e), seeds, 2)[0].groupBy("hop").count().collect()}
    assert (hops[0], hops[1], hops[0] + hops[2]) == (5, 17, 437)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).columns
