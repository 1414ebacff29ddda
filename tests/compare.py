"""Run registered queries in Spark and their SQL in DuckDB on one folder and compare rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from scorelake.plans.workload import BASE


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, name, fn, sql, folder):
    t0 = time.time()
    df = fn(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got[1])}", t1 - t0, 0.0, True
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    ok = got == want
    note = f"{len(got[1])} rows"
    if not ok:
        diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
        note = f"MISMATCH cols={got[0] if got[0] != want[0] else '='}/{want[0]} n={len(got[1])}/{len(want[1])} {diff}"
    return note, t1 - t0, t2 - t1, ok


def main(folder: str, *patterns: str) -> int:
    import __spark_entry__ as entry
    from scorelake.session import local_session

    spark, con = local_session(), connection(folder)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        try:
            note, spark_s, duck_s, ok = compare(spark, con, name, fn, oracle.get(name), folder)
        except Exception as exc:
            note, spark_s, duck_s, ok = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}", 0, 0, False
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:32s} spark {spark_s:6.2f}s duck {duck_s:6.2f}s  {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
