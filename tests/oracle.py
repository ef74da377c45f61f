"""Run registered queries beside their SQL in DuckDB and compare the results exactly.

``python tests/oracle.py [sf_dir] [key prefix …]`` prints mismatches and timings.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, float):
        return f"f:{value + 0.0!r}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, (dt.datetime, dt.date)):
        return f"t:{value.isoformat()}"
    return f"s:{value}"


def normal(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in a fixed order, cells tagged with their type."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, sf_dir: str, key: str, query, sql: str) -> str | None:
    df = query(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = normal([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(wrong)} of {len(want[1])} rows differ, first {wrong[0]}" if wrong else None


def main(sf_dir: str, prefixes: list[str]) -> int:
    from visitgrain.registry import ORACLES, QUERIES
    from visitgrain.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed, slow = connect(sf_dir), 0, []
    for key, query in QUERIES.items():
        if prefixes and not any(key == p or key.startswith(p + "_") or (p.endswith("*") and key.startswith(p[:-1])) for p in prefixes):
            continue
        start = time.time()
        try:
            if key in ORACLES:
                problem = differences(spark, con, sf_dir, key, query, ORACLES[key])
            else:
                rows = query(spark, sf_dir).collect()
                problem = None if rows else "no rows"
        except Exception as e:  # noqa: BLE001 - report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        slow.append((time.time() - start, key))
        if problem:
            failed += 1
            print(f"FAIL {key}: {problem}", flush=True)
    print(f"{len(slow)} queries, {failed} failed, {sum(s for s, _ in slow):.1f}s")
    print("slowest", [(k, round(s, 2)) for s, k in sorted(slow, reverse=True)[:12]])
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
