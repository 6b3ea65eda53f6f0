"""Compare a query with its DuckDB SQL over the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(sql, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def same(df, sql, folder):
    a, b = rows_of(df), sql_rows(sql, folder)
    assert a[0] == b[0]
    assert a[1] == b[1], (list((a[1] - b[1]).items())[:5], list((b[1] - a[1]).items())[:5])
