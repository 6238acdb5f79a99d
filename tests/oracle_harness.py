"""Run a Spark query and its DuckDB oracle on the same parquet tables and
compare row count, column names and an order-insensitive value hash."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def digest(columns, rows) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark_df, sql: str, sf_dir: str) -> dict:
    srows = [tuple(r) for r in spark_df.collect()]
    scols = list(spark_df.columns)
    con = duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out = {
        "rows_spark": len(srows), "rows_oracle": len(drows),
        "columns_match": sorted(scols) == sorted(dcols),
        "hash_match": digest(scols, srows) == digest(dcols, drows),
    }
    out["ok"] = out["rows_spark"] == out["rows_oracle"] and out["columns_match"] and out["hash_match"]
    if not out["ok"]:
        out["spark_cols"], out["oracle_cols"] = scols, dcols
        order_s = sorted(range(len(scols)), key=lambda i: scols[i])
        order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
        s_set = sorted(repr(tuple(_norm(r[i]) for i in order_s)) for r in srows)
        d_set = sorted(repr(tuple(_norm(r[i]) for i in order_d)) for r in drows)
        out["only_spark"] = [x for x in s_set if x not in set(d_set)][:3]
        out["only_oracle"] = [x for x in d_set if x not in set(s_set)][:3]
    return out
