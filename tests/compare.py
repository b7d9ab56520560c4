"""Run registered queries next to their SQL and compare names, types and values."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def sort_key(row):
    return tuple((value is None, str(type(value)), value if value is not None else 0)
                 for value in row)


def difference(df, con, sql) -> str | None:
    """None when the frame and the statement agree, else the first difference."""
    names = sorted(df.columns)
    result = con.execute(sql)
    sql_names = [column[0] for column in result.description]
    if sorted(sql_names) != names:
        return f"columns {names} against {sorted(sql_names)}"
    places = [sql_names.index(name) for name in names]
    expected = sorted((tuple(row[i] for i in places) for row in result.fetchall()),
                      key=sort_key)
    actual = sorted((tuple(row) for row in df.select(*names).collect()), key=sort_key)
    if len(expected) != len(actual):
        return f"{len(actual)} rows against {len(expected)}"
    for left, right in zip(actual, expected):
        for name, a, b in zip(names, left, right):
            if type(a) is not type(b):
                return f"{name}: {a!r} against {b!r}"
            if a != b and not (isinstance(a, float) and math.isnan(a) and math.isnan(b)):
                return f"{name}: {a!r} against {b!r} in {left} / {right}"
            if not isinstance(a, (int, float, str, datetime.date, type(None))):
                return f"{name}: type {type(a)}"
    return None


def main(sf: str, wanted: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from lendbook.session import build_session

    spark = build_session("local[8]", 8, driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, sql, failed = connect(sf_dir), oracle_sql(), 0
    unknown = set(sql) - set(queries())
    if unknown:
        print("SQL without query:", sorted(unknown))
    for name, build in queries().items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = difference(build(spark, sf_dir), con, sql[name])
            else:
                problem = None if build(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "sql" if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s "
              f"{problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
