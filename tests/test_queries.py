"""Every catalogue query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from rulespan.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = oracle.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    want = sorted(tuple(plain(r[at[c]]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
