"""Run registered queries and their SQL side by side and compare all values.

    python tests/oracle_check.py [sf0.001] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def canonical(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(canonical(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(table, key=repr)


def database(folder: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def compare(spark, connection, folder: str, name: str) -> str | None:
    """None when equal, else what differs."""
    frame = entry.queries()[name](spark, folder)
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(entry.oracle_sql()[name])
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        mine, theirs = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} rows against {len(want)}; only ours {sorted(mine - theirs)[:3]}; only SQL {sorted(theirs - mine)[:3]}"
    return None


def main() -> int:
    from tests.conftest import make_session

    arguments = sys.argv[1:]
    scale = arguments.pop(0) if arguments and arguments[0].startswith("sf") else "sf0.001"
    folder = f"/root/testdata/{scale}"
    spark, connection = make_session(), database(folder)
    failures = 0
    for name in arguments or entry.queries():
        start = time.time()
        if name not in entry.oracle_sql():
            found = f"no SQL; {entry.queries()[name](spark, folder).count()} rows"
            print(f"     {name}: {found} ({time.time() - start:.1f}s)", flush=True)
            continue
        try:
            problem = compare(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} ({time.time() - start:.1f}s) {problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main())
