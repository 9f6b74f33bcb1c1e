"""Run a named query on Spark and its oracle SQL on DuckDB; compare rows, schema and values.

Usage: python tests/oracle_harness.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(rows, key=lambda t: tuple("\x00" if x is None else x for x in t))


def compare(spark, con, name: str, sf_dir: str, spark_fn, sql: str) -> dict:
    t0 = time.time()
    sdf = spark_fn(spark, sf_dir)
    s_cols = sdf.columns
    s_recs = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_recs = res.fetchall()
    s_rows, d_rows = _rows(s_cols, s_recs), _rows(d_cols, d_recs)
    out = {
        "query": name,
        "rows_spark": len(s_rows), "rows_oracle": len(d_rows),
        "cols_match": sorted(s_cols) == sorted(d_cols),
        "values_match": s_rows == d_rows,
        "spark_sec": round(t1 - t0, 2),
    }
    out["hash_spark"] = hashlib.sha1(repr(s_rows).encode()).hexdigest()[:10]
    out["hash_oracle"] = hashlib.sha1(repr(d_rows).encode()).hexdigest()[:10]
    if not out["cols_match"]:
        out["cols_spark"], out["cols_oracle"] = sorted(s_cols), sorted(d_cols)
    elif not out["values_match"]:
        diff_s = [r for r in s_rows if r not in set(d_rows)][:3]
        diff_d = [r for r in d_rows if r not in set(s_rows)][:3]
        out["cols"] = sorted(s_cols)
        out["only_spark"], out["only_oracle"] = diff_s, diff_d
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    from pitchside.plans.catalog import queries
    from pitchside.plans.oracle import oracle_sql
    from pitchside.session import get_spark
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    q, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in q.items():
        if only and name not in only:
            continue
        if name not in sqls:
            print(f"{name:28s} (no oracle)")
            continue
        try:
            r = compare(spark, con, name, sf_dir, fn, sqls[name])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e).splitlines()[0][:300]}")
            continue
        ok = r["cols_match"] and r["values_match"] and r["rows_spark"] == r["rows_oracle"]
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} rows={r['rows_spark']}/{r['rows_oracle']} {r['spark_sec']}s")
        if not ok:
            for k in ("cols_spark", "cols_oracle", "cols", "only_spark", "only_oracle"):
                if k in r:
                    print(f"    {k}: {r[k]}")
    print(f"mismatches: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
