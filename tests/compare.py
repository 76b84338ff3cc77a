"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/compare.py [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v: object) -> object:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6) + 0.0
    return v


def _kind(v: object) -> str:
    return type(v).__name__


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns, rows and value types."""
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    res = con.execute(sql)
    theirs = [d[0] for d in res.description]
    if sorted(theirs) != names:
        return f"columns {names} != {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    types = dict(zip(theirs, map(str, con.sql(sql).types)))
    wrong = {f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema
             if SAME_TYPE.get(f.dataType.simpleString(), "?") != types[f.name]}
    if wrong:
        return f"types {wrong}"
    want = [tuple(r[i] for i in order) for r in res.fetchall()]
    for i, n in enumerate(names):
        a = {_kind(r[i]) for r in got if r[i] is not None}
        b = {_kind(r[i]) for r in want if r[i] is not None}
        if a != b:
            return f"column {n}: {a} != {b}"
    left = Counter(tuple(map(_cell, r)) for r in got)
    right = Counter(tuple(map(_cell, r)) for r in want)
    if left != right:
        a, b = list((left - right).items())[:3], list((right - left).items())[:3]
        return f"rows {len(got)} / {len(want)}; only Spark {a}; only SQL {b}"
    return None


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from stratawork.session import local_session

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name, run in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            what = differences(df, con, oracles[name]) if name in oracles \
                else f"no SQL, {df.count()} rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            what = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += bool(what) and not what.startswith("no SQL")
        print(f"{name:28s} {time.time() - start:6.2f}s {what or 'ok'}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
