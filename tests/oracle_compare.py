"""Run queries() and oracle_sql() side by side (the driver's correctness check, locally)."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def rows_of(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


# Spark simple type names → DuckDB type names
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
              "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, name, fn, sql, sf_dir, con, digits=None):
    digits = int(os.environ.get("LF_DIGITS", "9")) if digits is None else digits
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = [c for c in rel.columns]
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    s_types = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    res = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows), "spark_sec": round(t1 - t0, 2)}
    res["cols_match"] = sorted(s_cols) == sorted(d_cols)
    res["types_match"] = s_types == d_types
    if not res["types_match"]:
        res["types"] = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                        if s_types.get(c) != d_types.get(c)}
    if not res["cols_match"]:
        res["cols"] = (sorted(set(s_cols) - set(d_cols)), sorted(set(d_cols) - set(s_cols)))
        res["ok"] = False
        return res
    a, b = rows_of(s_cols, s_rows, digits), rows_of(d_cols, d_rows, digits)
    res["values_match"] = a == b
    res["ok"] = res["values_match"] and res["types_match"] and len(s_rows) == len(d_rows)
    if not res["ok"]:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["first_diffs"] = diffs
        res["cols_sorted"] = sorted(s_cols)
    return res


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from listenflow import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            df = fn(spark, sf_dir)
            print({"name": name, "rows": df.count(), "oracle": None}, flush=True)
            continue
        try:
            r = compare(spark, name, fn, sqls[name], sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": name, "ok": False, "error": repr(e)[:600]}
        bad += not r.get("ok")
        print(r, flush=True)
    print("FAILED", bad)
