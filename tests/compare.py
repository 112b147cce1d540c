"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

KIND = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def differences(spark, con, folder: str, name: str, run, sql: str | None) -> list[str]:
    df = run(spark, folder)
    found = df.collect()
    if sql is None:
        return []
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    wanted = cur.fetchall()
    problems = []
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} / {sorted(columns)}"]
    for column, kind in df.dtypes:
        if KIND.get(kind, kind) != kinds[column]:
            problems.append(f"type of {column}: {kind} / {kinds[column]}")
    ours, theirs = rows_of(df.columns, found), rows_of(columns, wanted)
    if ours != theirs:
        problems.append(f"rows {len(found)} / {len(wanted)}")
        problems += [f"only Spark: {row}" for row in list((ours - theirs))[:2]]
        problems += [f"only SQL:   {row}" for row in list((theirs - ours))[:2]]
    if not found:
        problems.append("no rows")
    return problems


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from landroll.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(
        spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = oracle_sql()
    bad = 0
    for name, run in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problems = differences(spark, con, folder, name, run, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", flush=True)
        for problem in problems:
            print("     ", problem[:700])
    print("without SQL:", sorted(set(queries()) - set(oracles)), "failed:", bad)


if __name__ == "__main__":
    main()
