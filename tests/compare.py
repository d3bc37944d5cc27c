"""Runs registered queries beside their SQL. Also a script:
``python tests/compare.py FOLDER [NAME ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: [(v is None, str(v)) for v in r]
    )


def compare(spark, con, folder: str, name: str) -> str | None:
    """What differs, or None."""
    df = contract.queries()[name](spark, folder)
    mine = rows_of(df.columns, df.collect())
    result = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{str(a)[:600]}\n  and {str(b)[:600]}"
        if [type(v) for v in a] != [type(v) for v in b]:
            return f"types of {str(a)[:300]} and {str(b)[:300]}"
    return None


if __name__ == "__main__":
    from instructset.session import local_session

    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    where = sys.argv[1]
    con = database(where)
    chosen = sys.argv[2:] or list(contract.queries())
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in contract.oracle_sql():
                problem = compare(session, con, where, name)
            else:
                n = len(contract.queries()[name](session, where).collect())
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if problem is None else 'DIFF ' + problem}", flush=True)
    print("differences:", bad)
