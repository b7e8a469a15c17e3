"""Run registered queries and compare them with their SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from fungo import catalog
from fungo.session import local_session
from fungo.views import BASE


def kind(v):
    if v is None:
        return None
    for t, n in ((bool, "bool"), (int, "int"), (float, "float"), (decimal.Decimal, "dec"), (str, "str"),
                 (dt.datetime, "ts"), (dt.date, "date"), (list, "list"), (dict, "dict")):
        if isinstance(v, t):
            return n
    return type(v).__name__


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, list):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    kinds = [next((kind(r[i]) for r in rows if r[i] is not None), None) for i in order]
    return [cols[i] for i in order], kinds, sorted(out, key=repr)


def check(spark, con, name, sf_dir):
    t0 = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    sc, sk, sv = table([[x.asDict(True) if hasattr(x, "asDict") else x for x in r] for r in rows], df.columns)
    if name not in catalog.ORACLE:
        return ("rows", f"{len(rows)} rows", took)
    t0 = time.time()
    cur = con.execute(catalog.ORACLE[name])
    cols = [d[0] for d in cur.description]
    oc, ok, ov = table(cur.fetchall(), cols)
    otook = time.time() - t0
    if sc != oc:
        return ("FAIL", f"columns {sc} vs {oc}", took)
    if sk != ok:
        return ("FAIL", f"types {list(zip(sc, sk, ok))}", took)
    if len(sv) != len(ov):
        return ("FAIL", f"rows {len(sv)} vs {len(ov)}", took)
    bad = [(a, b) for a, b in zip(sv, ov) if a != b]
    if bad:
        return ("FAIL", f"{len(bad)} of {len(sv)} differ {sc}: {bad[:2]}", took)
    nulls = [c for i, c in enumerate(sc) if sv and all(r[i] is None for r in sv)]
    return ("ok", f"{len(sv)} rows, sql {otook:.1f}s" + (f" ALL-NULL {nulls}" if nulls else ""), took)


def connect(sf_dir):
    con = duckdb.connect()
    for n in BASE:
        con.execute(f"create view {n} as select * from '{sf_dir}/{n}.parquet'")
    return con


def main(names, sf="0.01"):
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            state, note, took = check(spark, con, name, sf_dir)
        except Exception as e:
            state, note, took = "FAIL", f"{type(e).__name__}: {str(e)[:700]}", 0
        bad += state == "FAIL"
        if state == "FAIL" or "-v" in sys.argv or took > 8 or "ALL-NULL" in note:
            print(f"{state:5} {name:32} {took:5.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} failed")
    return bad


if __name__ == "__main__":
    import importlib

    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    for a in args:
        if a.startswith("@"):
            importlib.import_module(f"fungo.catalog.{a[1:]}")
    picked = [a for a in args if not a.startswith("@") and not a.startswith("sf=")]
    sf = next((a[3:] for a in args if a.startswith("sf=")), "0.01")
    if not any(a.startswith("@") for a in args):
        catalog.load()
    sys.exit(bool(main(picked or list(catalog.QUERIES), sf)))
