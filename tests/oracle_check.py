"""Run registered queries against their DuckDB oracles (the driver's compare, locally).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def frame_digest(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf.astype({c: "float64" for c in cols if str(pdf[c].dtype) == "Int64"})  # longs with nulls, as Spark's frames hold them
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records"))
    return cols, len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest(), rows


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None):
    import __spark_entry__ as E

    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t = time.time()
        try:
            spdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            out[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, out[name], flush=True)
            continue
        ts = time.time() - t
        if name not in ors:
            out[name] = f"rows-only {len(spdf)}"
            print(name, out[name], flush=True)
            continue
        try:
            dpdf = con.sql(ors[name]).df()
        except Exception as e:  # noqa: BLE001
            out[name] = f"SQL ERROR {str(e)[:300]}"
            print(name, out[name], flush=True)
            continue
        a, b = frame_digest(spdf), frame_digest(dpdf)
        ok = a[0] == b[0] and a[1] == b[1] and a[2] == b[2]
        out[name] = "OK" if ok else f"MISMATCH cols {a[0]} vs {b[0]} rows {a[1]} vs {b[1]}"
        print(f"{name}: {out[name]} ({len(spdf)} rows, spark {ts:.1f}s)", flush=True)
        if not ok and a[0] == b[0]:
            sa, sb = set(a[3]), set(b[3])
            for r in list(sa - sb)[:2]:
                print("  spark only:", r[:400])
            for r in list(sb - sa)[:2]:
                print("  duck only: ", r[:400])
    return out


if __name__ == "__main__":
    from quire.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    rows_only = [k for k, v in res.items() if v.startswith("rows-only")]
    bad = [k for k, v in res.items() if v != "OK" and k not in rows_only]
    print("rows-only (no oracle):", rows_only)
    print("FAILED:", bad)
