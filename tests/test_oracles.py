"""Every query with SQL gives the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest
from graphs import SMALL
from tripleloom import catalogue


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    r = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - {"f_path_stats", "g_generate", "signature_categories"}))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
