"""Compares every query that has SQL with DuckDB, as multisets of rows, columns by name."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def key(row: dict) -> tuple:
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return int(v) if isinstance(v, int) and not isinstance(v, bool) else v

    return tuple((c, plain(row[c])) for c in sorted(row))


def compare(df, sql: str, sf_dir: str) -> tuple[int, int, list]:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    want = Counter(key(dict(zip(names, r, strict=True))) for r in got.fetchall())
    mine = Counter(key(r.asDict()) for r in df.collect())
    return sum(mine.values()), sum(want.values()), list((mine - want).items())[:2] + list((want - mine).items())[:2]
