"""Run a query in Spark and its SQL in DuckDB and compare the row multisets."""

from __future__ import annotations

import datetime
import glob
import os
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.4f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def difference(columns, rows, oracle_columns, oracle_rows) -> str | None:
    if sorted(columns) != sorted(oracle_columns):
        return f"columns {columns} != {oracle_columns}"
    order = [columns.index(c) for c in sorted(columns)]
    oracle_order = [oracle_columns.index(c) for c in sorted(columns)]
    left = Counter(tuple(normal(r[i]) for i in order) for r in rows)
    right = Counter(tuple(normal(r[i]) for i in oracle_order) for r in oracle_rows)
    if left == right:
        return None
    return (
        f"{sum(left.values())} vs {sum(right.values())} rows; columns {sorted(columns)}; "
        f"only spark {list((left - right).items())[:3]}; only sql {list((right - left).items())[:3]}"
    )


def run_sql(con, sql: str):
    rel = con.sql(sql)
    return rel.columns, [str(t) for t in rel.types], rel.fetchall()


SPARK_TO_SQL = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def check(query, spark, con, folder: str) -> tuple[int, str | None]:
    df = query.run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if query.sql is None:
        return len(rows), None
    columns, types, oracle_rows = run_sql(con, query.oracle())
    spark_types = {c: SPARK_TO_SQL.get(t, t) for c, t in df.dtypes}
    wrong = [(c, spark_types.get(c), t) for c, t in zip(columns, types) if spark_types.get(c) != t]
    if wrong:
        return len(rows), f"types {wrong}"
    return len(rows), difference(df.columns, rows, columns, oracle_rows)
