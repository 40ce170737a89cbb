"""The corpus queries that SQL can express, against their SQL on the smallest tables."""

import pytest

from rulespan.llm.queries import QUERIES, SQL
from tests.test_queries import SF, oracle, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, oracle, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = oracle.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[at[c]]) for c in columns) for r in result.fetchall())
