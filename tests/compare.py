"""Results of Spark against results of DuckDB over the same tables."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain(x):
    """A hashable value that is equal for equal results of either engine."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return bytes(x) if isinstance(x, bytearray | memoryview) else x


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, sf_dir: str) -> int:
    """df and sql give the same columns and the same bag of rows; returns how many."""
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want, got = bag(found.fetchall(), names), bag(df.collect(), df.columns)
    missing, extra = want - got, got - want
    assert not missing and not extra, f"{sum(missing.values())} missing, {sum(extra.values())} extra of {sum(want.values())}: {list(missing)[:2]} / {list(extra)[:2]}"
    return sum(got.values())
