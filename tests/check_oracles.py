"""Compares registered queries with their checking SQL on DuckDB.

    python tests/check_oracles.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from plumbline.plans.views import TABLES  # noqa: E402
from plumbline.session import build_session  # noqa: E402


TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(rows: list, columns: list[str]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """Empty when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if ours else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    wanted = {d[0]: str(d[1]).upper() for d in cursor.description}
    types = {n: (k, wanted[n]) for n, k in df.dtypes if TYPES.get(k) not in (wanted[n], None)}
    if types:
        return f"types {types}"
    a, b = canonical(ours, df.columns), canonical(theirs, columns)
    if a == b:
        return "" if a else "both empty"
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    return f"rows {len(a)} / {len(b)}; spark {sorted(only_a)[:2]} duckdb {sorted(only_b)[:2]}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in args.names or entry.queries():
        start = time.time()
        try:
            fault = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            fault = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(fault) and fault != "both empty"
        kind = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if not fault else 'BAD '} {kind} {name} {time.time() - start:.1f}s {fault}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
