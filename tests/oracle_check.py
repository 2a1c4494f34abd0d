"""Compare registered queries with their SQL on the same tables: python tests/oracle_check.py [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (float, Decimal)):
        number = float(value)
        if math.isnan(number):
            return "nan"
        return str(int(number)) if number.is_integer() else f"{number:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf):
    df = query(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only {len(got)}", True
    cursor = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} <> {want_cols}", False
    if got != want:
        extra = list(set(got) - set(want))[:3]
        missing = list(set(want) - set(got))[:3]
        return f"rows {len(got)} <> {len(want)}\n   spark only: {extra}\n   sql only:   {missing}", False
    return f"{len(got)} rows", True


def main() -> None:
    import __spark_entry__ as entry
    from tenuis.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = []
    for name in names:
        start = time.time()
        try:
            message, ok = compare(spark, connect(sf), name, queries[name], oracles.get(name), sf)
        except Exception as error:
            message, ok = f"{type(error).__name__}: {str(error)[:1500]}", False
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
