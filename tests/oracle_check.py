"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and types, and an order-insensitive value hash."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(int(v)) if v.is_integer() else repr(round(v, 6))
    if hasattr(v, "item"):
        v = v.item()
        return _norm(v)
    return repr(v)


def canon(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return cols, rows


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def type_diff(sdf_schema, rel) -> dict:
    s = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf_schema.fields}
    d = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}


def compare(spark, con, name, qfn, sql, sf_dir):
    t0 = time.time()
    sq = qfn(spark, sf_dir)
    sdf = sq.toPandas()
    t1 = time.time()
    ddf = con.execute(sql).df()
    t2 = time.time()
    types = type_diff(sq.schema, con.sql(sql))
    sc, sr = canon(sdf)
    dc, dr = canon(ddf)
    ok = sc == dc and sr == dr and not types
    info = f"{name}: spark {len(sr)} rows {t1 - t0:.1f}s, duck {len(dr)} rows {t2 - t1:.1f}s -> {'OK' if ok else 'MISMATCH'}"
    if types:
        info += f"\n  types (spark, duck): {types}"
    if not ok:
        if sc != dc:
            info += f"\n  cols spark={sc} duck={dc}"
        else:
            a, b = set(sr), set(dr)
            info += f"\n  only spark ({len(a - b)}): {sorted(a - b)[:3]}\n  only duck ({len(b - a)}): {sorted(b - a)[:3]}"
    return ok, info


def main(argv):
    sys.path.insert(0, "/root/repo")
    from abode.session import local_session
    import __spark_entry__ as E
    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    names = argv[1:] or sorted(E.queries())
    spark = local_session(8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        if n not in os_:
            t0 = time.time()
            cnt = qs[n](spark, sf_dir).count()
            print(f"{n}: rows-only {cnt} rows {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            ok, info = compare(spark, con, n, qs[n], os_[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{n}: ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(info, flush=True)
    print("mismatches:", bad)


if __name__ == "__main__":
    main(sys.argv)
