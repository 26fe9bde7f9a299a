"""Run the registered queries and their SQL side by side: python -m checks.compare SF_DIR [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracles import oracle_sql
from checks.queries import QUERIES
from copyloom.fixtures import TABLES
from copyloom.session import local_session


def normal(value):
    if value is None:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    return str(value)


def sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def compare(spark, connection, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    found = QUERIES[name](spark, sf_dir)
    ours = sorted_rows(found.columns, found.collect())
    seconds = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(ours)} rows, {seconds:.1f} s"
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = sorted_rows(columns, result.fetchall())
    summary = f"{len(ours)} / {len(theirs)} rows, {seconds:.1f} s, duckdb {time.time() - started - seconds:.1f} s"
    if sorted(columns) != sorted(found.columns):
        return False, f"columns differ: {sorted(found.columns)} / {sorted(columns)}"
    types = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    mapped = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    wrong = {c: (t, types[c]) for c, t in found.dtypes if mapped.get(types[c], types[c]) != t}
    if wrong:
        summary += f", types {wrong}"
    if ours != theirs:
        only_ours = [r for r in ours if r not in set(theirs)][:3]
        only_theirs = [r for r in theirs if r not in set(ours)][:3]
        return False, f"{summary}\n   only spark: {only_ours}\n   only duckdb: {only_theirs}"
    return True, summary


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    failed = []
    for name in names:
        try:
            same, text = compare(spark, connection, sf_dir, name)
        except Exception as error:  # a broken query must not hide the others
            same, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if same else "FAIL", name, text, flush=True)
        if not same:
            failed.append(name)
    print(len(names) - len(failed), "of", len(names), "agree; failed:", failed)


if __name__ == "__main__":
    main()
