"""Run registered queries on Spark and their SQL twins on DuckDB; compare like the driver does.

python -m tests.oracle_check [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

import __spark_entry__ as entry_mod
from riskweave.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]
    return len(rows), h


def compare(spark, con, sf_dir: str, name: str, verbose: bool = True) -> bool:
    qs = entry_mod.queries()
    sqls = entry_mod.oracle_sql()
    t0 = time.time()
    sdf = qs[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if name not in sqls:
        print(f"{name:28s} rows-only spark={len(srows)} ({t1 - t0:.1f}s)")
        return True
    rel = con.sql(sqls[name])
    dcols = rel.columns
    drows = rel.fetchall()
    sn, sh = digest(scols, srows)
    dn, dh = digest(dcols, drows)
    ok = sorted(scols) == sorted(dcols) and sn == dn and sh == dh
    print(f"{name:28s} {'OK  ' if ok else 'FAIL'} spark={sn} duck={dn} ({t1 - t0:.1f}s)"
          + ("" if sorted(scols) == sorted(dcols) else f" cols {scols} vs {dcols}"))
    if not ok and verbose:
        order_s = sorted(range(len(scols)), key=lambda i: scols[i])
        order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
        ss = sorted("|".join(_norm(r[i]) for i in order_s) for r in srows)
        dd = sorted("|".join(_norm(r[i]) for i in order_d) for r in drows)
        only_s = sorted(set(ss) - set(dd))[:5]
        only_d = sorted(set(dd) - set(ss))[:5]
        print("   spark only:", only_s)
        print("   duck only: ", only_d)
    return ok


def main(argv):
    from riskweave.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(entry_mod.queries())
    spark = local_session()
    con = duck(sf_dir)
    bad = [n for n in names if not compare(spark, con, sf_dir, n)]
    print("FAILED:", bad if bad else "none")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
