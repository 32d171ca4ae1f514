"""Intermediate tables that survive the loss of executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

WORK_DIR = "spanrate.work.dir"


def use_work_dir(spark: SparkSession, path: str) -> None:
    """Name the folder for intermediate tables; all machines must share it.

    ``spark.checkpoint.dir`` of the session comes first.
    """
    spark.conf.set(WORK_DIR, path)


def work_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(WORK_DIR, None)
    if not folder:
        raise ValueError(
            "intermediate tables need a folder that all machines share:"
            " set spark.checkpoint.dir or call use_work_dir"
        )
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the work folder that nobody else uses; ``clear_work_dir`` removes it."""
    return f"{work_dir(spark)}/spanrate-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    A table, unlike a cached frame, outlives its executors; the scan that replaces the
    lineage is columnar and knows its size, which the planner uses for later joins.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_work_dir(spark: SparkSession) -> None:
    """Remove all intermediate tables; no frame made with them can be read any more."""
    pattern = hadoop_path(spark, f"{work_dir(spark)}/spanrate-*")
    system = file_system(spark, pattern)
    for found in system.globStatus(pattern) or []:
        system.delete(found.getPath(), True)


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target = hadoop_path(spark, path)
    return file_system(spark, target).exists(target)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, or None if there is none."""
    target = hadoop_path(spark, path)
    system = file_system(spark, target)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    target, fresh = hadoop_path(spark, path), hadoop_path(spark, f"{path}.new-{uuid.uuid4().hex}")
    system = file_system(spark, target)
    stream = system.create(fresh)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    system.delete(target, False)
    if not system.rename(fresh, target):
        raise OSError(f"{fresh.toString()} cannot be moved")


def children(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match ``pattern``, sorted."""
    target = hadoop_path(spark, pattern)
    found = file_system(spark, target).globStatus(target) or []
    return sorted(f.getPath().toString() for f in found)


def remove(spark: SparkSession, path: str) -> None:
    target = hadoop_path(spark, path)
    file_system(spark, target).delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    here = hadoop_path(spark, target)
    system = file_system(spark, here)
    system.mkdirs(here.getParent())
    if not system.rename(hadoop_path(spark, source), here):
        raise OSError(f"{source} cannot be moved to {target}")


def settle_table(spark: SparkSession, path: str) -> None:
    """Finish a swap that was cut off: a table has one writer, so what lies beside it is its own.

    Between the two moves of ``swap_table`` the complete new content takes the table's place;
    should that be missing, the old content goes back.  Before or after, leftovers go.
    """
    fresh, old = (children(spark, f"{path}{end}-*") for end in (".new", ".old"))
    if not exists(spark, path):
        complete = [p for p in fresh if exists(spark, f"{p}/_SUCCESS")]
        if old and complete:
            move(spark, complete[-1], path)
        elif old:
            move(spark, old[-1], path)
    for left in fresh + old:
        remove(spark, left)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def swap_table(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] = write_parquet) -> None:
    """Replace the table at ``path``, from which ``df`` may be read.

    The new content is complete beside the old before either is moved, so a failed write leaves
    the table as it was; ``settle_table``, with which readers and the next swap begin, finishes
    a swap whose driver was lost between the moves.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    settle_table(spark, path)
    fresh, old = (f"{path}{end}-{mark}" for end in (".new", ".old"))
    write(df, fresh)
    if exists(spark, path):
        move(spark, path, old)
    move(spark, fresh, path)
    remove(spark, old)
