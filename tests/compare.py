"""Compare each named query with its SQL: ``python tests/compare.py <folder> [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted(
        (tuple(normal(row[name]) for name in names) for row in frame.collect()), key=repr
    )


def sql_rows(connection, sql: str):
    cursor = connection.execute(sql)
    found = [column[0] for column in cursor.description]
    names = sorted(found)
    places = [found.index(name) for name in names]
    return names, sorted(
        (tuple(normal(row[place]) for place in places) for row in cursor.fetchall()), key=repr
    )


def difference(frame, connection, sql: str) -> str | None:
    """None if both give the same columns and rows."""
    names, ours = spark_rows(frame)
    other_names, theirs = sql_rows(connection, sql)
    if names != other_names:
        return f"columns {names} / {other_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} / {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"{names}\n  {a}\n  {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from ledgerloom.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles = connect(folder), oracle_sql()
    failed = 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        frame = query(spark, folder)
        if name in oracles:
            found = difference(frame, connection, oracles[name])
            failed += found is not None
            state = "same" if found is None else f"DIFFERENT {found}"
        else:
            state = f"no SQL, {frame.count()} rows"
        print(f"{name:30} {time.time() - started:6.2f}s {state}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
