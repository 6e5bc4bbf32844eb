"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tools/compare.py [sf_dir] [name-prefix ...]
Reports row count, column names and an order-insensitive value hash per query.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from maskforge.plans.registry import load_all  # noqa: E402
from maskforge.session import get_session  # noqa: E402
from maskforge.sources.tables import TABLES, table_path  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()[:12], lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    reg = load_all()
    spark = get_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    bad = 0
    for name, q in sorted(reg.items()):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:34s} SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.oracle is None:
            print(f"{name:34s} rows={len(srows):7d} spark={ts:6.2f}s (no oracle)")
            continue
        t1 = time.time()
        try:
            cur = con.execute(q.oracle)
            drows = cur.fetchall()
            dcols = [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            print(f"{name:34s} DUCK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        td = time.time() - t1
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
        bad += not ok
        print(f"{name:34s} {'OK ' if ok else 'BAD'} rows={len(srows):7d}/{len(drows):7d} "
              f"spark={ts:6.2f}s duck={td:6.2f}s")
        if not ok:
            if sorted(scols) != sorted(dcols):
                print("   cols", sorted(scols), sorted(dcols))
            diff_s = [x for x in ls if x not in set(ld)][:3]
            diff_d = [x for x in ld if x not in set(ls)][:3]
            print("   spark-only", [d[:300] for d in diff_s])
            print("   duck-only ", [d[:300] for d in diff_d])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
