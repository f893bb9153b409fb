"""Every core query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessella import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple("" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    """What they give is held against plain versions in test_operators.py."""
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
