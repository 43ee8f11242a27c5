"""Every query with SQL returns the same rows as DuckDB on the same tables."""

import duckdb
import pytest

from palimpsest.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_all_queries_have_sql():
    assert set(catalogue.SQL) == set(catalogue.QUERIES)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert got == rows(names, found.fetchall())
