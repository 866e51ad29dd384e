"""Rows of a query and of its SQL, comparable."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir, text):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    done = con.sql(text)
    return done.columns, done.fetchall()


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=str)


def same(df, sf_dir, text):
    columns, rows = sql_rows(sf_dir, text)
    order = sorted(df.columns)
    assert sorted(columns) == order
    assert plain([tuple(r) for r in df.collect()], df.columns, order) == plain(rows, columns, order)
