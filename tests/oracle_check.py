"""Differential check: each registered query vs its DuckDB oracle SQL.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, column names and an order-insensitive value
hash (exact), plus a tolerant comparison when the exact hash differs.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from strata.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        return float(v)
    return v


def rows_of(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, [tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False)]


def value_hash(rows):
    hs = sorted(hashlib.md5(repr(r).encode()).hexdigest() for r in rows)
    return hashlib.md5("".join(hs).encode()).hexdigest()


def close_match(a, b, tol=1e-9):
    key = lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, float) else round(x, 6))
                          for x in r)
    a, b = sorted(a, key=key), sorted(b, key=key)
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if isinstance(x, float) and isinstance(y, (float, int)):
                if not math.isclose(x, y, rel_tol=tol, abs_tol=tol):
                    return False
            elif x != y:
                return False
    return True


def check(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or qs:
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark-error", str(e)[:400])
            if verbose:
                print(f"{name:28s} SPARK ERROR {str(e)[:400]}", flush=True)
            continue
        ts = time.time() - t0
        if name not in orc:
            results[name] = ("rows-only", len(sp))
            if verbose:
                print(f"{name:28s} rows-only rows={len(sp)} {ts:.1f}s", flush=True)
            continue
        try:
            dk = con.sql(orc[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = ("sql-error", str(e)[:400])
            if verbose:
                print(f"{name:28s} SQL ERROR {str(e)[:400]}", flush=True)
            continue
        cs, rs = rows_of(sp)
        cd, rd = rows_of(dk)
        same_cols = cs == cd
        exact = same_cols and len(rs) == len(rd) and value_hash(rs) == value_hash(rd)
        approx = same_cols and len(rs) == len(rd) and close_match(rs, rd)
        status = "OK" if exact else ("APPROX" if approx else "MISMATCH")
        results[name] = (status, len(rs), len(rd))
        if verbose:
            print(f"{name:28s} {status:8s} rows={len(rs)}/{len(rd)} {ts:.1f}s"
                  + ("" if same_cols else f" cols {cs} vs {cd}"), flush=True)
    return results


if __name__ == "__main__":
    from strata.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark()
    res = check(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "rows-only")]
    print("NOT OK:", bad)
