"""Run queries in Spark and DuckDB side by side: `python tests/compare.py [sf_dir] [names…]`."""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(None if r[i] is None else str(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql, sf_dir):
    """`(rows in Spark, rows in DuckDB, only in Spark, only in DuckDB, seconds in Spark)`."""
    df = query(spark, sf_dir)
    start = time.time()
    ours = df.collect()
    spent = time.time() - start
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    left, right = rows_of(df.columns, ours), rows_of(names, theirs)
    return len(ours), len(theirs), left - right, right - left, spent


def main() -> int:
    from tests.session import session
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args else "/root/testdata/sf0.01"
    spark, con, sqls, bad = session(), connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            n, m, left, right, spent = difference(spark, con, query, sqls[name], sf_dir)
            good = n == m and not left and not right
            print(f"{'ok ' if good else 'BAD'} {name} {n} {m} spark {spent:.1f}s all {time.time() - start:.1f}s", flush=True)
            if not good:
                bad += 1
                print("   spark only:", list(left)[:3], "\n   duckdb only:", list(right)[:3], flush=True)
        except Exception as exc:
            bad += 1
            print("ERR", name, type(exc).__name__, str(exc)[:600], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
