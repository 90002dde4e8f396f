"""Compare registered queries with their SQL: ``python -m tests.oracle [--sf DIR] [name ...]``."""

from __future__ import annotations

import argparse
import time
from pathlib import Path

import duckdb

from corpusloom import catalog
from corpusloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(spark, con, name: str, sf_dir: str, counts: dict[str, int] | None = None) -> str | None:
    """None if both engines give the same rows, else what differs."""
    ours = catalog.queries()[name](spark, sf_dir)
    columns = sorted(ours.columns)
    rows = sorted((tuple(r) for r in ours.select(columns).collect()), key=repr)
    if counts is not None:
        counts[name] = len(rows)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return None
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    index = [names.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in index) for r in result.fetchall()), key=repr)
    if len(rows) != len(theirs):
        return f"{len(rows)} rows and {len(theirs)}"
    for a, b in zip(rows, theirs):
        if a != b:
            return f"{str(a)[:300]} and {str(b)[:300]}"
    return None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(args.sf)
    failed = 0
    counts: dict[str, int] = {}
    for name in args.names or catalog.queries():
        start = time.time()
        try:
            problem = difference(spark, con, name, args.sf, counts)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {counts.get(name)} rows {problem or ''}", flush=True)
    print(f"{failed} failed", flush=True)


if __name__ == "__main__":
    main()
