"""Side-by-side check of every catalogue query against its DuckDB SQL.

Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``.  Prints one line
per query (rows, columns, value hash) and exits non-zero on any mismatch.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.9g}" if abs(v) >= 1e-12 else "0"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def value_hash(columns: list[str], rows: list[tuple]) -> tuple[str, list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            out[name] = {"ok": False, "error": f"spark: {type(e).__name__}: {str(e)[:300]}"}
            if verbose:
                print(f"{name:28s} SPARK ERROR {out[name]['error']}")
            continue
        t1 = time.time()
        if name not in sql:
            out[name] = {"ok": True, "rows": len(s_rows), "oracle": False, "sec": round(t1 - t0, 2)}
            if verbose:
                print(f"{name:28s} rows={len(s_rows):7d} (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            res = con.execute(sql[name])
            d_cols = [c[0] for c in res.description]
            d_rows = [tuple(r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            out[name] = {"ok": False, "error": f"duckdb: {type(e).__name__}: {str(e)[:300]}"}
            if verbose:
                print(f"{name:28s} DUCKDB ERROR {out[name]['error']}")
            continue
        hs, ls = value_hash(s_cols, s_rows)
        hd, ld = value_hash(d_cols, d_rows)
        ok = sorted(s_cols) == sorted(d_cols) and len(s_rows) == len(d_rows) and hs == hd
        out[name] = {"ok": ok, "rows": len(s_rows), "oracle_rows": len(d_rows), "sec": round(t1 - t0, 2)}
        if verbose:
            print(f"{name:28s} rows={len(s_rows):7d}/{len(d_rows):7d} cols={'ok' if sorted(s_cols)==sorted(d_cols) else 'DIFF'} "
                  f"hash={'ok' if hs == hd else 'DIFF'} {t1 - t0:.1f}s")
            if not ok:
                if sorted(s_cols) != sorted(d_cols):
                    print("   spark cols:", sorted(s_cols))
                    print("   duck  cols:", sorted(d_cols))
                sd = sorted(set(ls) - set(ld))[:3]
                dd = sorted(set(ld) - set(ls))[:3]
                for x in sd:
                    print("   spark only:", x[:300])
                for x in dd:
                    print("   duck  only:", x[:300])
    return out


def main():
    from modspark.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", 8)
    res = compare(spark, sf_dir, names)
    bad = [k for k, v in res.items() if not v.get("ok")]
    print(f"{len(res) - len(bad)}/{len(res)} ok; bad: {bad}")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
