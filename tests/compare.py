"""Run registered queries and their SQL side by side and compare all values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):  # decimals are values of another type
        return ("decimal", str(value))
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(data, key=repr)


def compare(spark, con, folder, name, query, sql) -> str | None:
    """None when equal, else what differs."""
    started = time.time()
    df = query(spark, folder)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    cursor = con.execute(sql)
    theirs = table([d[0] for d in cursor.description], cursor.fetchall())
    print(f"{name}: {len(ours[1])} rows, {took:.1f}s + {time.time() - started - took:.1f}s", flush=True)
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if ours[1] == theirs[1]:
        return None
    left, right = set(map(repr, ours[1])), set(map(repr, theirs[1]))
    return (
        f"rows {len(ours[1])} / {len(theirs[1])}; only ours: {[x[:300] for x in sorted(left - right)[:2]]} ({len(left - right)}); "
        f"only sql: {[x[:300] for x in sorted(right - left)[:2]]} ({len(right - left)})"
    )


if __name__ == "__main__":
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from folioscope.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = local_session(), duck(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in wanted or queries:
        try:
            if name not in sqls:
                print(f"{name}: no sql, {queries[name](spark, folder).count()} rows")
                continue
            problem = compare(spark, con, folder, name, queries[name], sqls[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            bad += 1
            print(f"  DIFFERS {name}: {problem}", flush=True)
    print("differing:", bad)
