"""Run a query on Spark and its oracle on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else float(f"{value:.10g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect()), dict(df.dtypes)


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]).lower() for d in cursor.description}
    return sorted(names), rows_of(names, cursor.fetchall()), types


def difference(df, con, sql, show=3) -> str | None:
    """None if both sides agree, else a short account of how they do not."""
    names, mine, _ = spark_rows(df)
    other_names, theirs, _ = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} against {other_names}"
    if mine == theirs:
        return None
    only_mine, only_theirs = mine - theirs, theirs - mine
    return (
        f"{sum(mine.values())} against {sum(theirs.values())} rows;"
        f" {sum(only_mine.values())} only in Spark, {sum(only_theirs.values())} only in SQL\n"
        f"  {names}\n  spark {list(only_mine)[:show]}\n  sql   {list(only_theirs)[:show]}"
    )
