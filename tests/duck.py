"""Rows of a query against those of its SQL, which DuckDB runs on the same tables."""

import math
import os

import duckdb


def order(row):
    return [(x is None, 0 if x is None else x) for x in row]


def same_rows(df, sql, sf):
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=order)
    with duckdb.connect() as con:
        for name in os.listdir(sf):
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}{'/*.parquet' if os.path.isdir(f'{sf}/{name}') else ''}')")
        found = con.execute(sql)
        assert sorted(c[0] for c in found.description) == columns
        names = [c[0] for c in found.description]
        want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)
