"""Run registered queries against their SQL twins on one data folder: ``python tests/compare.py [-k part] [sf_dir]``."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def normal(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return float(v)
    if hasattr(v, "asDict"):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(normal(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> str:
    started = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(normal(row[c]) for c in cols) for row in df.collect()), key=repr)
    took = time.time() - started
    if sql is None:
        return f"rows {len(got)} only, spark {took:.1f}s"
    started = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"FAIL columns {cols} / {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted((tuple(normal(row[i]) for i in order) for row in cur.fetchall()), key=repr)
    duck_took = time.time() - started
    if got == want:
        return f"ok {len(got)} rows, spark {took:.1f}s, sql {duck_took:.1f}s"
    if len(got) != len(want):
        return f"FAIL rows {len(got)} / {len(want)}\n   {str([x for x in got if x not in set(want)][:2])[:500]}\n   {str([x for x in want if x not in set(got)][:2])[:500]}"
    bad = {}
    for a, b in zip(got, want):
        for c, x, y in zip(cols, a, b):
            if x != y:
                bad.setdefault(c, []).append((x, y))
    return "FAIL values " + "; ".join(f"{c}: {len(v)} e.g. {str(v[:2])[:160]}" for c, v in bad.items())


def main() -> int:
    from barograph.session import build_session
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    part = args.pop(args.index("-k") + 1) if "-k" in args else ""
    args = [a for a in args if a != "-k"]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.ui.showConsoleProgress": "false", "spark.sql.constraintPropagation.enabled": "true"})  # as a plain session has it
    spark.sparkContext.setLogLevel("ERROR")
    con, twins, failed = duck(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if not any(p in name for p in part.split(",")):
            continue
        try:
            result = compare(spark, con, fn, twins.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            result = f"FAIL {type(exc).__name__}: {str(exc)[:600]}"
        failed += result.startswith("FAIL") or not (result.startswith("ok") or result.startswith("rows"))
        print(f"{name}: {result}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
