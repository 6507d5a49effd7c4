import os

import duckdb
import pytest

from quire.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [d[0] for d in r.description]
        want = sorted((tuple(dict(zip(names, row, strict=True))[c] for c in columns) for row in r.fetchall()), key=repr)
        assert sorted(names) == columns and got == want
