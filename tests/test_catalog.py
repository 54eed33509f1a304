"""Every query with SQL gives DuckDB's rows; the others run and keep a schema."""

import glob
import os

import duckdb
import pytest

from veilspark.plans import case_queries, catalog, training_queries  # noqa: F401 - the others add their queries to the catalogue's


def rows(df):
    df = df[sorted(df.columns)].astype(str)
    return sorted(map(tuple, df.values.tolist()))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    mine = catalog.QUERIES[name](spark, sf_dir).toPandas()
    sql = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    assert rows(mine) == rows(sql)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
