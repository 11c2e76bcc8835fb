"""Compare queries with their SQL: schema names, row count and every value."""

from __future__ import annotations

import sys
import time

import duckdb

from pickwell.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _rows(records, order):
    return sorted((tuple(r[i] for i in order) for r in records), key=repr)


def compare(spark, connection, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return "cross join in the plan"
    got = [tuple(r) for r in df.collect()]
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    order = sorted(range(len(names)), key=lambda i: names[i])
    mine = _rows(got, [df.columns.index(names[i]) for i in order])
    theirs = _rows(want, order)
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"value {a} / {b}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from pickwell.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(queries())
    spark, connection = local_session(), connect(sf_dir)
    for name in wanted:
        start = time.time()
        try:
            sql = oracle_sql().get(name)
            if sql is None:
                outcome = f"no SQL, {queries()[name](spark, sf_dir).count()} rows"
            else:
                outcome = compare(spark, connection, sf_dir, queries()[name], sql) or "ok"
        except Exception as error:
            outcome = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28} {time.time() - start:6.1f}s {outcome}", flush=True)


if __name__ == "__main__":
    main()
