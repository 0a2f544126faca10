"""Run registered queries beside their DuckDB statements and compare the results.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(name: str, df, con, statement: str) -> str:
    """Empty when equal, else what differs."""
    cursor = con.execute(statement)
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    expected = rows(columns, cursor.fetchall())
    got = rows(df.columns, df.collect())
    if got == expected:
        return ""
    extra, lacking = got - expected, expected - got
    return (
        f"{sum(got.values())} rows against {sum(expected.values())}; only in Spark "
        f"{sum(extra.values())}: {list(extra)[:3]}; only in DuckDB {sum(lacking.values())}: {list(lacking)[:3]}"
    )


def main() -> None:
    import __spark_entry__ as entry
    from epithet.session import get_spark

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = get_spark(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(sf_dir), entry.queries(), entry.oracle_sql()
    for name in wanted or queries:
        if name not in oracle:
            print(f"{name:28s} no statement", flush=True)
            continue
        start = time.time()
        try:
            verdict = compare(name, queries[name](spark, sf_dir), con, oracle[name]) or "ok"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
