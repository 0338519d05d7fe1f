"""Run registered queries next to their SQL and report differences.

    python tests/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def checker(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(rows) -> list[tuple]:
    def cell(v):
        if v is None or v != v:
            return (0, "")
        return (1, repr(float(v)) if isinstance(v, (int, float)) else str(v))

    return sorted(tuple(cell(v) for v in row) for row in rows)


def differences(spark, con, query, folder: str) -> tuple[int, list[str], float, float]:
    """Row count, messages, Spark seconds and SQL seconds."""
    began = time.time()
    df = query.run(spark, folder)
    names = sorted(df.columns)
    got = [tuple(row[n] for n in names) for row in df.collect()]
    spark_seconds = time.time() - began
    if query.sql is None:
        return len(got), [], spark_seconds, 0.0
    began = time.time()
    result = con.execute(query.sql)
    columns = [d[0] for d in result.description]
    messages = []
    if sorted(columns) != names:
        return len(got), [f"columns {names} against {sorted(columns)}"], spark_seconds, 0.0
    order = [columns.index(n) for n in names]
    expected = [tuple(row[i] for i in order) for row in result.fetchall()]
    sql_seconds = time.time() - began
    if len(got) != len(expected):
        messages.append(f"{len(got)} rows against {len(expected)}")
    a, b = canonical(got), canonical(expected)
    if a != b:
        only_spark = sorted(set(a) - set(b))[:2]
        only_sql = sorted(set(b) - set(a))[:2]
        bad = len(set(a) - set(b))
        for x, y in zip(only_spark, only_sql, strict=False):
            diff = [(n, p[1], q[1]) for n, p, q in zip(names, x, y, strict=True) if p != q]
            messages.append(f"{bad} differ: {diff[:4]} in {[p[1] for p in x][:6]}")
        if not only_spark or not only_sql:
            messages.append(f"spark only {only_spark}, sql only {only_sql}")
    return len(got), messages, spark_seconds, sql_seconds


def main() -> int:
    from priorwise.plans.catalog import REGISTRY
    from priorwise.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("prefixes", nargs="*")
    args = parser.parse_args()
    folder = f"{TESTDATA}/sf{args.sf}"
    spark, con = local_session(), checker(folder)
    failed = 0
    for name, query in REGISTRY.items():
        if args.prefixes and not any(name.startswith(p) for p in args.prefixes):
            continue
        try:
            rows, messages, s, d = differences(spark, con, query, folder)
        except Exception as error:  # noqa: BLE001
            rows, messages, s, d = -1, [str(error)[:1500]], 0.0, 0.0
        mark = "FAIL" if messages else ("ok" if query.sql else "rows")
        print(f"{mark:4} {name:45} rows={rows} spark={s:.1f}s sql={d:.1f}s", *messages, sep="\n     " if messages else " ", flush=True)
        failed += bool(messages)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
