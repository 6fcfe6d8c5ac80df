"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if not (n[0] == "p" and n[1].isdigit())]


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def show(v):
        if hasattr(v, "item"):
            v = v.item()
        if v is None or v != v or v is pd.NaT:
            return "NULL"
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(show(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, tables, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        want = tables.execute(SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["sequence_windows", "shard_manifest"])
def test_tokens_are_not_shuffled(spark, data, name):
    """The texts are shuffled as bytes, once; shards are neither collected by an aggregate nor moved as lists of ids."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan and plan.count("RepartitionByExpression") == 1


@pytest.mark.parametrize(("name", "without"), [("sequence_windows", "tokens#"), ("shard_manifest", "MapInArrow")])
def test_shards_are_not_rows(spark, data, name, without):
    """No row holds the tokens of a whole shard; sizes alone need neither texts in a shuffle nor Python."""
    assert without not in QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
