"""Runs a query's SQL in DuckDB over the same tables."""

import os

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf: str) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    return sorted((tuple(v for _, v in sorted(zip(names, row))) for row in r.fetchall()), key=repr)


def rows(df) -> list[tuple]:
    return sorted((tuple(v for _, v in sorted(r.asDict().items())) for r in df.collect()), key=repr)


ODD = "doc_id long, text string, lang string, source string, n_chars long, digest int, Salt int, score double, _bucket int"


def odd(spark, texts, lang="en"):
    """Documents with clashing extra columns; texts: (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, lang, "s", None, 1, 2, 0.5, 3) for i, t in texts], ODD)
