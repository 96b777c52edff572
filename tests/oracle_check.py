"""Local stand-in for the driver's correctness gate.

Runs every ``queries()`` entry of ``__spark_entry__`` on an sf directory and
its ``oracle_sql()`` text in DuckDB, then compares row counts, column names,
column types (mapped to a common family) and an order-insensitive hash of the
values. Usage: ``python tests/oracle_check.py [sf_dir] [key ...]``.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("ORACLE_EXACT") else round(v, 6)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in sorted(v.items())}
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str, sort_keys=True) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    import duckdb

    import __spark_entry__ as entry
    from shotbank.session import build_session

    if os.environ.get("ORACLE_PLAIN"):  # a bare session, as an outside driver would build it
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
                 .getOrCreate())
    else:
        spark = build_session("local[8]", shuffle_partitions=8,
                              extra={"spark.ui.showConsoleProgress": "false"})
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
            stypes = [f.dataType.simpleString() for f in df.schema.fields]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            res = con.execute(sqls[name])
            ocols = [d[0] for d in res.description]
            otypes = [str(d[1]) for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        problems = []
        if sorted(scols) != sorted(ocols):
            problems.append(f"columns {sorted(scols)} vs {sorted(ocols)}")
        if len(srows) != len(orows):
            problems.append(f"rows {len(srows)} vs {len(orows)}")
        if not problems:
            hs, ls = _digest(scols, srows)
            ho, lo = _digest(ocols, orows)
            if hs != ho:
                diff = [x for x in ls if x not in set(lo)][:2]
                diff2 = [x for x in lo if x not in set(ls)][:2]
                problems.append(f"values differ: spark {diff} duck {diff2}")
        types = dict(zip(scols, stypes)), dict(zip(ocols, otypes))
        if problems:
            bad += 1
            print(f"FAIL {name}: {'; '.join(problems)[:1500]}")
        else:
            print(f"OK   {name}: {len(srows)} rows {dt:.1f}s types {sorted(types[0].items())} | {sorted(types[1].items())}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
