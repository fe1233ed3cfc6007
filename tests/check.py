"""Run queries in Spark and their SQL in DuckDB on the same files and compare all rows.

    python tests/check.py [sf_dir] [query ...]
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

import __spark_entry__ as driver  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, con, sf_dir: str, name: str) -> list[str]:
    df = driver.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = con.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    found = []
    if sorted(columns) != sorted(df.columns):
        found.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    if got != want:
        found.append(f"rows {got.total()} != {want.total()}")
        found.append(f"only in Spark {list((got - want).items())[:3]}")
        found.append(f"only in SQL {list((want - got).items())[:3]}")
    if not want:
        found.append("no rows")
    return found


if __name__ == "__main__":
    from tertulia.plans.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(driver.oracle_sql())
    session, duck = local_session(8), connect(sf)
    print("without SQL:", sorted(set(driver.queries()) - set(driver.oracle_sql())))
    for key in names:
        start = time.time()
        try:
            problems = differences(session, duck, sf, key)
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{'ok ' if not problems else 'BAD'} {key} {time.time() - start:.1f}s")
        for line in problems:
            print("     ", line)
