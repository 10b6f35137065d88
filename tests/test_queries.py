"""Every query against its SQL on the smallest tables, and the catalogue's own rules."""

import math

import duckdb
import pytest

from gradeloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert got == ordered(tuple(plain(r[i]) for i in at) for r in answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["sheet", "score", "total", "review_flags", "dropped", "status"]
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.ORACLE_SQL) <= set(entry.oracle_sql())
