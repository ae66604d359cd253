"""Compares a query with its SQL as sets of rows."""

from __future__ import annotations

import duckdb

from sluice.sources.bindings import TABLES


def rows(columns, records):
    def plain(v):
        if v is None or v != v:
            return "~"
        return repr(float(v)) if isinstance(v, bool | int | float) or hasattr(v, "dtype") else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    assert sorted(got.columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())
