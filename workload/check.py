"""Run registered queries against their SQL: ``python -m workload.check <sf_dir> [query …]``."""

from __future__ import annotations

import sys
import time

import duckdb

from plumbline.session import local_session

from .oracle import statements
from .queries import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str) -> str:
    """Empty when the rows agree, else what differs."""
    return difference(all_queries()[name](spark, sf_dir), con, name)


def difference(df, con, name: str) -> str:
    columns = sorted(df.columns)
    ours = [tuple(row[c] for c in columns) for row in df.collect()]
    text = statements().get(name)
    if text is None:
        return "" if ours else "no rows"
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = [tuple(row[i] for i in at) for row in cursor.fetchall()]
    ours, theirs = (sorted(rows, key=repr) for rows in (ours, theirs))
    if ours == theirs:
        return ""
    extra = [r for r in ours if r not in set(theirs)][:2]
    missing = [r for r in theirs if r not in set(ours)][:2]
    return f"{len(ours)} rows != {len(theirs)}; only ours {extra}; only theirs {missing}"


def main(sf_dir: str, *only: str) -> int:
    spark, con, failed = local_session(8), connect(sf_dir), 0
    for name in only or all_queries():
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # keep checking the others
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{name:34s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
