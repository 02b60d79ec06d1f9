"""Runs every named query on Spark and its SQL on DuckDB and compares names, types' families and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return v + 0.0 if v else 0.0
    return v


def sort_key(row):
    return tuple((x is not None, str(type(x)), x if x is not None else 0) for x in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=sort_key)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, con, sql):
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    duck_cols, duck_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if spark_cols != duck_cols:
        return f"columns differ: {spark_cols} / {duck_cols}"
    if len(spark_rows) != len(duck_rows):
        return f"rows differ: {len(spark_rows)} / {len(duck_rows)}"
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(spark_rows)} rows differ, e.g. {bad[0][0]} / {bad[0][1]}"
    kinds = [(c, {type(r[i]).__name__ for r in spark_rows} - {"NoneType"}, {type(r[i]).__name__ for r in duck_rows} - {"NoneType"}) for i, c in enumerate(spark_cols)]
    off = [k for k in kinds if k[1] != k[2]]
    return f"types differ: {off}" if off else None


if __name__ == "__main__":
    from tests.conftest import make_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark, con = make_session(), duck(sf_dir)
    queries, oracles, failed = entry.queries(), entry.oracle_sql(), 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if len(df.collect()) > 0 else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.perf_counter() - start:6.2f}s {'' if name in oracles else '(rows) '}{problem or ''}", flush=True)
    print(f"{failed} failed")
