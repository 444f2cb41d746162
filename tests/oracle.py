"""Compares queries with their SQL in DuckDB: python tests/oracle.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, date) else x if x is None else str(x)


def compare(spark, name: str, sf: str) -> str:
    """"" if the rows are the same, or what differs."""
    import duckdb

    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted((tuple(value(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    if got == want:
        return ""
    odd = next(((a, b) for a, b in zip(got, want) if a != b), None)
    return f"{len(got)} rows and {len(want)}; first that differ: {columns} {odd}"


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark, bad = session(), 0
    for name in args or entry.queries():
        began = time.time()
        try:
            said = compare(spark, name, sf)
        except Exception as e:  # a report on all of them
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{'ok ' if not said else said if said.startswith('rows only') else 'BAD ' + said} {name} {time.time() - began:.1f} s", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
