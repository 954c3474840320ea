"""Compare registered queries with their DuckDB twins: `python tests/check.py <folder> [names...]`."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _kind(value) -> str:
    return type(value).__name__


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    left = spark_df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    order = sorted(names)
    a = sorted(tuple(_plain(r[c]) for c in order) for r in left)
    index = [names.index(c) for c in order]
    b = sorted(tuple(_plain(r[i]) for i in index) for r in right)
    for x, y in zip(a, b):
        if x != y:
            diff = [(c, p, q) for c, p, q in zip(order, x, y) if p != q]
            return f"first difference {diff[:3]} in row {x[:4]}"
    for column in order:
        kinds_a = {_kind(r[column]) for r in left if r[column] is not None}
        kinds_b = {_kind(r[names.index(column)]) for r in right if r[names.index(column)] is not None}
        if kinds_a != kinds_b:
            return f"types of {column}: {kinds_a} != {kinds_b}"
    if not left:
        return "no rows"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from revtide.session import build_session

    folder = sys.argv[1]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    bad = 0
    for name in chosen:
        begun = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - begun:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print("failed:", bad, "of", len(chosen), "without twin:", sorted(set(queries) - set(oracles)))


if __name__ == "__main__":
    main()
