"""Compare a query with its oracle: same columns, same kinds of type, same rows."""

import datetime as dt
import math
from decimal import Decimal

import duckdb

from workload.model import DRIVER_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(type_name: str) -> str:
    t = type_name.lower()
    for name in ("timestamp", "decimal", "date"):
        if t.startswith(name):
            return name
    names = {"varchar": "string", "integer": "int", "bool": "boolean"}
    return names.get(t, t)


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.10g}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    types = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    return names, types, sorted(tuple(cell(v) for v in r) for r in rows)


def duckdb_rows(con, sql):
    rel = con.sql(sql)
    types = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types)}
    names = sorted(rel.columns)
    index = [rel.columns.index(n) for n in names]
    return names, types, sorted(tuple(cell(r[i]) for i in index) for r in rel.fetchall())


def difference(df, con, sql) -> str | None:
    """None if equal, else a short description."""
    a_names, a_types, a = spark_rows(df)
    b_names, b_types, b = duckdb_rows(con, sql)
    if a_names != b_names:
        return f"columns {sorted(set(a_names) ^ set(b_names))}"
    if a_types != b_types:
        return f"types {[(n, a_types[n], b_types[n]) for n in a_names if a_types[n] != b_types[n]]}"
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{[(n, p, q) for n, p, q in zip(a_names, x, y) if p != q]} of key {x[:3]}"
    return None
