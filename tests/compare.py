"""Runs registered queries and their SQL side by side; also usable as a script."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value)
    if isinstance(value, bool):
        return str(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, run, sql):
    """Returns (ok, message)."""
    start = time.time()
    frame = run(spark, sf_dir)
    got = frame.collect()
    took = time.time() - start
    start = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    oracle = time.time() - start
    note = f"rows={len(got)} spark={took:.2f}s oracle={oracle:.2f}s"
    if sorted(frame.columns) != sorted(columns):
        return False, f"{note} columns differ: {sorted(frame.columns)} vs {sorted(columns)}"
    a, b = rows_of(frame.columns, got), rows_of(columns, expected)
    if a == b:
        return True, note
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return False, f"{note} expected rows={len(b)}\n   spark only: {only_a}\n   sql only:   {only_b}"


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from gaugewise.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    chosen = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, run in queries.items():
        if chosen and not any(name.startswith(prefix) for prefix in chosen):
            continue
        try:
            if name in oracles:
                ok, message = compare(spark, con, sf_dir, run, oracles[name])
            else:
                start = time.time()
                n = run(spark, sf_dir).count()
                ok, message = n > 0, f"rows={n} spark={time.time() - start:.2f}s (no SQL)"
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
