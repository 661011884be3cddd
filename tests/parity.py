"""Compares a query with its DuckDB SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return float(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = query(spark, sf_dir)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    odd = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(odd)} of {len(got[1])} rows differ, as {str(odd[0][0])[:300]} and {str(odd[0][1])[:300]}" if odd else ""
