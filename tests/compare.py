"""Run registered queries and their SQL side by side and compare all values exactly."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def normal_rows(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def run_pair(spark, con, name: str, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    got = normal_rows(df.columns, df.collect())
    middle = time.time()
    cursor = con.execute(sql)
    want = normal_rows([c[0] for c in cursor.description], cursor.fetchall())
    note = f"spark {middle - start:.1f}s sql {time.time() - middle:.1f}s rows {len(got[1])}"
    if got[0] != want[0]:
        return False, f"{note} columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        only = sorted(set(got[1]) ^ set(want[1]), key=repr)[:4]
        return False, f"{note} != {len(want[1])}; e.g. {only}"
    different = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    if different:
        return False, f"{note} {len(different)} rows differ: {different[:2]}"
    return True, note


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from labspark.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session, connection = local_session(8), connect(folder)
    sqls, failed = oracle_sql(), []
    for key, run in queries().items():
        if wanted and key not in wanted:
            continue
        try:
            ok, text = run_pair(session, connection, key, folder, run, sqls[key])
        except Exception as exc:  # report and go on with the next query
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print("ok  " if ok else "FAIL", key, text, flush=True)
        failed += [] if ok else [key]
    print("failed:", failed)
