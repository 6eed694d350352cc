"""Runs every registered query on Spark and its oracle on DuckDB and compares the rows.

Usage: python tools/check_oracles.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import collections
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from gapspark import registry  # noqa: E402
from gapspark.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for name, e in registry.entries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            df = e.run(spark, sf)
            cols = sorted(df.columns)
            got = [tuple(norm(v) for v in r) for r in df.select(*cols).collect()]
            t1 = time.time()
            if e.oracle is None:
                print(f"ROWS  {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
                continue
            rel = con.sql(e.oracle)
            ocols = sorted(rel.columns)
            idx = [rel.columns.index(c) for c in ocols]
            exp = [tuple(norm(r[i]) for i in idx) for r in rel.fetchall()]
            t2 = time.time()
            ok = cols == ocols and collections.Counter(got) == collections.Counter(exp)
            print(f"{'OK   ' if ok else 'DIFF '} {name}: {len(got)}/{len(exp)} rows "
                  f"spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", flush=True)
            if not len(got):
                print("   (empty result)")
            if not ok:
                bad.append(name)
                if cols != ocols:
                    print("   columns", cols, ocols)
                a, b = collections.Counter(got), collections.Counter(exp)
                print("   cols", cols)
                print("   only spark", list((a - b).items())[:3])
                print("   only duck ", list((b - a).items())[:3])
            else:
                dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
                for f in df.schema.fields:
                    s, o = f.dataType.simpleString(), dt[f.name]
                    same = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE",
                            "boolean": "BOOLEAN"}.get(s)
                    if same and same != o:
                        print(f"   type {f.name}: spark {s} duck {o}")
        except Exception as ex:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {str(ex)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
