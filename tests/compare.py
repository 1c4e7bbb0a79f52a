"""Run a query in Spark and its SQL in DuckDB, and compare rows as sorted multisets."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    ours, theirs = sorted(df.columns), sorted(rel.columns)
    if ours != theirs:
        return f"columns {set(ours) ^ set(theirs)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    odd = [(n, t, types[n]) for n, t in df.dtypes if SAME.get(t, t) != types[n]]
    left = Counter(
        tuple(map(_cell, r)) for r in df.select(*[f"`{c}`" for c in ours]).toPandas().astype(object)
        .where(lambda p: p.notna(), None).itertuples(index=False, name=None)
    )
    right = Counter(
        tuple(map(_cell, r))
        for r in rel.select(", ".join(f'"{c}"' for c in ours)).fetchall()
    )
    if left != right:
        only = list((left - right).items())[:2], list((right - left).items())[:2]
        return f"rows {sum(left.values())} vs {sum(right.values())}: {str(only)[:1500]}"
    return f"types {odd}" if odd else None
