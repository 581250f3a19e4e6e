"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import duckdb
import pytest

from quirework import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("null" if v is None else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tables, name):
    df = QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in ORACLE:
        assert got
        return
    rel = duck.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(got) == plain([tuple(r[i] for i in order) for r in rel.fetchall()])


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
