"""Runs a registered query on Spark and its SQL on DuckDB and compares the two results exactly.

    python tests/parity.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN", "float": "FLOAT", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]",
    "timestamp": "TIMESTAMP",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        tail = '/*.parquet' if os.path.isdir(f'{sf_dir}/{name}.parquet') else ''
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet{tail}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def compare(spark_rows, spark_schema, con, sql: str) -> str:
    """Empty text when equal, otherwise what differs."""
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    ours = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_schema}
    if ours != theirs:
        diff = sorted(set(ours.items()) ^ set(theirs.items()))
        return f"schema differs: {diff[:10]}"
    names = sorted(ours)
    left = sorted(tuple(plain(r[n]) for n in names) for r in spark_rows)
    index = [rel.columns.index(n) for n in names]
    right = sorted(tuple(plain(r[i]) for i in index) for r in rel.fetchall())
    if len(left) != len(right):
        return f"rows differ: spark {len(left)} sql {len(right)}"
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        a, b = bad[0]
        cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        return f"{len(bad)} rows differ, first: {cells[:4]}"
    return ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tallyloom.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = local_session(8)
    con = duck(sf)
    plans, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv or list(plans):
        start = time.time()
        try:
            df = plans[name](spark, sf)
            rows = df.collect()
            spent = time.time() - start
            if name in oracles:
                verdict = compare(rows, df.schema, con, oracles[name]) or "ok"
            else:
                verdict = "ok (rows only)"
        except Exception as error:  # noqa: BLE001
            spent, rows = time.time() - start, []
            verdict = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        failed += not verdict.startswith("ok")
        print(f"{name:32s} {len(rows):7d} rows {spent:6.2f}s  {verdict}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
