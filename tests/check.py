"""Run registered queries against their SQL twins: ``python tests/check.py [sf] [name ...]``."""
import sys
import time
import zlib
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def canon(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.6f}" if v != 0 else "0.000000"
    if hasattr(v, "isoformat"):
        v = pd.Timestamp(v)
        return (v.tz_convert("UTC").tz_localize(None) if v.tzinfo else v).isoformat()
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted("|".join(canon(v) for v in r)
                        for r in pdf[cols].astype(object).itertuples(index=False, name=None))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, name, query, sql, verbose=True):
    t0 = time.time()
    got = query(spark, sf_dir).toArrow().to_pandas(integer_object_nulls=True)
    t1 = time.time()
    if sql is None:
        if verbose:
            print(f"ROWS {name} {len(got)} rows {t1 - t0:.1f}s", flush=True)
        return True
    want = con.execute(sql).df()
    t2 = time.time()
    ca, a = rows_of(got)
    cb, b = rows_of(want)
    ok = ca == cb and a == b
    if verbose:
        print(f"{'ok  ' if ok else 'FAIL'} {name} {len(a)} rows spark {t1 - t0:.1f}s "
              f"duck {t2 - t1:.1f}s", flush=True)
        if not ok:
            print("  cols", [c for c in ca if c not in cb], [c for c in cb if c not in ca])
            print("  rows", len(a), len(b), zlib.crc32("".join(a).encode()))
            only_a = sorted(set(a) - set(b))[:4]
            only_b = sorted(set(b) - set(a))[:4]
            print("  ", ca)
            for r in only_a:
                print("  spark", r[:600])
            for r in only_b:
                print("  duck ", r[:600])
    return ok


def main():
    import __spark_entry__ as e
    from tidewire.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = sys.argv[2:]
    qs, sqls = e.queries(), e.oracle_sql()
    bad = []
    for name, q in qs.items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1]))
                             for n in names):
            continue
        try:
            if not compare(spark, con, sf_dir, name, q, sqls.get(name)):
                bad.append(name)
        except Exception as ex:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {str(ex)[:1500]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
