"""Every query with SQL gives the rows DuckDB gives on the same tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry_points

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(value(r[i]) for i in order) for r in records), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, str(SF))
    relation = duck.sql(entry_points.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: kinds[c] for c in df.columns}
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(relation.fetchall(), relation.columns)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert len(df.columns) == 34 and df.count() > 0


def test_no_query_is_lost():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
