"""Compare registered queries with their SQL in DuckDB.

``python tests/oracle.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(value):
    if value is None:
        return "\0null"
    if isinstance(value, float):
        return "\0null" if math.isnan(value) else repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty when both sides agree, otherwise the first difference."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    rel = con.execute(sql)
    cols = {d[0]: str(d[1]) for d in rel.description}
    raw = rel.fetchall()
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}"
    order = [[d[0] for d in rel.description].index(n) for n in names]
    want = [tuple(r[i] for i in order) for r in raw]
    types = {n: TYPES.get(dict(df.dtypes)[n], dict(df.dtypes)[n]) for n in names}
    sql_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if types != {n: sql_types[n] for n in names}:
        return f"types { {n: (types[n], sql_types[n]) for n in names if types[n] != sql_types[n]} }"
    a, b = sorted(tuple(map(cell, r)) for r in got), sorted(tuple(map(cell, r)) for r in want)
    if not a and not b:
        return "no rows"
    if len(a) != len(b):
        extra = sorted(set(a) - set(b))[:1], sorted(set(b) - set(a))[:1]
        return f"rows {len(a)} != {len(b)} {extra}"
    for x, y in zip(a, b):
        if x != y:
            return f"{names}\n   spark {x}\n   sql   {y}"[:3000]
    return ""


def main() -> None:
    from corpusloom.plans import load_all
    from corpusloom.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].replace(".", "").isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = load_all()
    bad = 0
    for name in args or list(queries):
        start = time.time()
        try:
            if name in oracles:
                message = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                n = len(queries[name](spark, sf_dir).collect())
                message = "" if n else "no rows"
        except Exception as exc:
            message = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(message)
        print(f"{'ok  ' if not message else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows only) '}{message}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
