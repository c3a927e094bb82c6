"""Every registered query against its SQL on the smallest tables, if they are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from kairoscope.plans import registry

SF = entry_point.SMOKE_DIR
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(clean(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, name):
    got = registry.QUERIES[name](spark, SF)
    rows = got.collect()
    if name in registry.ORACLES:
        want = sql.execute(registry.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert normal(rows, got.columns) == normal(want.fetchall(), names)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize(("name", "column", "table", "whole"), [("file_history", "sum(changes)", "lineitem", "count(*)"), ("chunk_headers", "count(*)", "documents", "count(*)"), ("temporal_ppr", "count(DISTINCT project_id)", "customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey", "count(DISTINCT c_nationkey)")])
def test_whole_tables(spark, sql, name, column, table, whole):
    got = registry.QUERIES[name](spark, SF).selectExpr(column).first()[0]
    assert got == sql.execute(f"SELECT {whole} FROM {table}").fetchone()[0]
