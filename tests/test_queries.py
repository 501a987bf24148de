"""Every registered query against the SQL that states its rows."""

import duckdb
import pytest

import __spark_entry__ as registered
from maskwright.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, sql, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = sql.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert [str(t) for t in got[columns].dtypes] == [str(t) for t in want[columns].dtypes]
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    out = registered.entry(spark)
    assert out.columns == ["doc_id", "redacted_text", "n_replacements"] and out.count() > 0


def test_registered_names():
    assert QUERIES.keys() <= registered.queries().keys()
    assert registered.oracle_sql().keys() <= registered.queries().keys()


def test_the_flagship_is_one_scan(spark, sf):
    plan = QUERIES["redact_email_placeholder"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
