"""Side-by-side run of registered queries and their SQL on DuckDB: python -m tests.compare [dir] [name parts]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        value = value.item()
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got)
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first only here {next((r for r in got if r not in set(want)), None)}", len(got)
    for a, b in zip(got, want):
        if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-6))
                              or (isinstance(y, float) and isinstance(x, (int, float)) and math.isclose(x, y, abs_tol=2e-6))
                              for x, y in zip(a, b)):
            return f"{got_cols}\n   spark {a}\n   sql   {b}", len(got)
    return None, len(got)


def main() -> int:
    from broadsheet.catalog import QUERIES, SQL
    from broadsheet.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, q in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        at = time.time()
        try:
            problem, n = compare(spark, con, name, q, SQL.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if name in SQL else "rows")
        print(f"{mark:5} {name:40} {n:7} rows {time.time() - at:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
