"""Local stand-in for the driver's correctness gate: Spark query vs DuckDB oracle.

usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: repr(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    df = df.astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


SPARK_TO_DUCK = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT"}


def type_mismatches(sdf_types: dict, con, sql: str) -> dict:
    rel = con.sql(sql)
    duck = {name: str(t) for name, t in zip(rel.columns, rel.types)}
    out = {}
    for c, st in sdf_types.items():
        want = SPARK_TO_DUCK.get(st, st.upper())
        if duck.get(c) != want:
            out[c] = (st, duck.get(c))
    return out


def compare(spark, sf_dir: str, keys: list[str] | None = None) -> dict:
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for k in keys or list(qs):
        t0 = time.time()
        try:
            sdf_spark = qs[k](spark, sf_dir)
            stypes = dict(sdf_spark.dtypes)
            sdf = sdf_spark.toPandas()
            ts = time.time() - t0
        except Exception as e:  # noqa: BLE001
            report[k] = {"error": f"spark: {type(e).__name__}: {str(e)[:400]}"}
            print(k, report[k], flush=True)
            continue
        if k not in sql:
            report[k] = {"rows": len(sdf), "oracle": None, "spark_s": round(ts, 2)}
            print(k, report[k], flush=True)
            continue
        t1 = time.time()
        try:
            odf = con.execute(sql[k]).df()
        except Exception as e:  # noqa: BLE001
            report[k] = {"error": f"duckdb: {type(e).__name__}: {str(e)[:400]}"}
            print(k, report[k], flush=True)
            continue
        to = time.time() - t1
        r = {"rows": len(sdf), "oracle_rows": len(odf), "spark_s": round(ts, 2), "duck_s": round(to, 2)}
        r["cols_match"] = sorted(sdf.columns) == sorted(odf.columns)
        tm = type_mismatches(stypes, con, sql[k])
        if tm:
            r["type_mismatch"] = tm
        if r["cols_match"] and len(sdf) == len(odf):
            a, b = canon(sdf), canon(odf)
            diff = (a != b).any(axis=1)
            r["value_match"] = not bool(diff.any())
            if diff.any():
                i = int(diff.idxmax())
                bad = [c for c in a.columns if a.loc[i, c] != b.loc[i, c]]
                r["first_diff"] = {c: (a.loc[i, c], b.loc[i, c]) for c in bad[:4]}
                r["n_diff_rows"] = int(diff.sum())
        else:
            r["value_match"] = False
            r["spark_cols"], r["oracle_cols"] = list(sdf.columns), list(odf.columns)
        report[k] = r
        print(k, r, flush=True)
    return report


if __name__ == "__main__":
    from tickscope.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    rep = compare(spark, sf, keys)
    ok = sum(1 for v in rep.values() if v.get("value_match"))
    print(json.dumps({"ok": ok, "total": len(rep)}))
