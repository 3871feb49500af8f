"""Run a registered query and its SQL on the same tables and compare the two results."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both results hold the same columns and rows, else a short description."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    want = _rows(columns, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got != want:
        pairs = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"rows {len(got)} vs {len(want)}; first differences {pairs}; columns {sorted(columns)}"
    spark_kinds = dict(df.dtypes)
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = {c: (spark_kinds[c], kinds[c]) for c in columns if names.get(spark_kinds[c]) != kinds[c]}
    return f"types {wrong}" if wrong else None
