"""Which tasks still have to run, and what has run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateTask(ValueError):
    """A ledger with two entries for one task."""


def checksum(column: Column | str) -> Column:
    return F.md5(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def _shared(left: DataFrame, right: DataFrame, key: Sequence[str]) -> list[str]:
    return [c for c in key if c in left.columns and c in right.columns]


def matching(df: DataFrame, key_rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``key_rows``; none if a key column is missing."""
    shared = _shared(df, key_rows, key)
    if len(shared) < len(key):
        return df.limit(0)
    return df.join(key_rows.select(*shared).distinct(), shared, "left_semi")


def check_ledger(ledger: DataFrame, key: Sequence[str]) -> DataFrame:
    twice = ledger.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1).take(1)
    if twice:
        raise DuplicateTask(f"duplicate key {twice[0].asDict()} in the ledger")
    return ledger


def required_tasks(tasks: DataFrame, ledger: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Tasks without a ledger entry of the same key and checksum."""
    if ledger is None:
        return tasks
    done = ledger.select(*key, "checksum").distinct()
    return tasks.join(done, [*key, "checksum"], "left_anti")


def is_task_required(ledger: DataFrame | None, key: dict, new_checksum: str) -> bool:
    """One task against the ledger; two entries for its key are an error."""
    if ledger is None:
        return True
    entry = ledger
    for name, value in key.items():
        entry = entry.where(F.col(name) == value)
    found = entry.select("checksum").take(2)
    if len(found) > 1:
        raise DuplicateTask(f"duplicate key {key} in the ledger")
    return not found or found[0].checksum != new_checksum


def record_tasks(
    ledger: DataFrame | None, done: DataFrame, key: Sequence[str], when: Column | None = None
) -> DataFrame:
    """The ledger with the entries of ``done`` (key, checksum) replaced or added."""
    stamped = done.select(*key, "checksum").withColumn(
        "time_stamp", F.current_timestamp() if when is None else when
    )
    if ledger is None:
        return stamped
    return keyed_replace(ledger, stamped, key)


def keyed_replace(previous: DataFrame, data: DataFrame, key: Sequence[str]) -> DataFrame:
    """``previous`` without the keys of ``data``, then ``data``; missing columns become NULL."""
    kept = previous.join(data.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(data, allowMissingColumns=True)
