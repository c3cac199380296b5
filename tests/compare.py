"""Run registered queries beside their SQL: `python tests/compare.py SF [name...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def folder(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder(sf)}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return str(value) if not isinstance(value, (int, str, type(None), bool)) else value


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def check(spark, connection, sf: str, name: str, run, sql: str | None) -> str:
    """'' if both sides agree, else what differs."""
    frame = run(spark, folder(sf))
    mine = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if not mine:
        return "no rows"
    if sql is None:
        return ""
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    theirs = rows(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if len(mine) != len(theirs):
        extra = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} rows against {len(theirs)}: {str(extra)[:1500]}"
    wrong = [(m, t) for m, t in zip(mine, theirs) if m != t]
    return f"{len(wrong)} of {len(mine)} rows differ: {str(wrong[0])[:1500]}" if wrong else ""


if __name__ == "__main__":
    from duolex import suite
    from duolex.session import build_session

    scale, wanted = sys.argv[1], sys.argv[2:] or list(suite.QUERIES)
    session, database = build_session("compare", 8), oracle(scale)
    bad = 0
    for query in wanted:
        began = time.time()
        try:
            told = check(session, database, scale, query, suite.QUERIES[query], suite.SQL.get(query))
        except Exception as error:  # noqa: BLE001 - report and go on
            told = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += bool(told)
        print(f"{'FAIL' if told else 'ok  '} {query} {time.time() - began:.1f}s {told}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
