"""Result tables: partitioned cohort tables, site tables, CSV exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.network import (
    SITE_FILE,
    ColumnMismatch,
    FieldSpec,
    all_fields,
    check_columns,
    check_names,
    coerce_types,
    drop_duplicate_keys,
    fill_key_nulls,
    first_file_wins,
    primary_key,
    split_conflicts,
)
from ..operators.ledger import keyed_replace
from ..schemas import COHORT_DDL, IR_SUMMARY_DDL, conform, rename_all, snake_case, struct_type
from .durable import exists, settle_table, swap_table
from .record_files import SITE_LINE, csv_files, record_files
from .reuse import reused

COHORT_PARTITION = "cohort_definition_id"


def create_cohort_table(spark: SparkSession, path: str) -> None:
    """An empty cohort table, replacing what is there."""
    empty = spark.createDataFrame([], struct_type(COHORT_DDL))
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        COHORT_PARTITION
    ).parquet(path)


def _replace_partitions(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        column
    ).parquet(path)


def read_cohort_table(spark: SparkSession, path: str) -> DataFrame:
    """Partition values come back as the long they were."""
    frame = spark.read.schema(struct_type(COHORT_DDL)).parquet(path)
    return conform(frame, COHORT_DDL).where(F.col("subject_id").isNotNull())


def write_cohorts(df: DataFrame, path: str, cohort_ids: Sequence[int]) -> None:
    """Replace the cohorts ``cohort_ids`` by the rows of ``df``; other cohorts stay.

    A dynamic partition overwrite replaces the partitions that get rows.  One marker row
    without a subject per cohort makes an empty result replace an earlier one as well.
    """
    spark = df.sparkSession
    ids = F.array(*[F.lit(i).cast("long") for i in cohort_ids])
    marker = spark.range(1).select(F.explode(ids).alias("cohort_definition_id"))
    rows = conform(df, COHORT_DDL).where(F.col("cohort_definition_id").isin(*cohort_ids))
    _replace_partitions(
        rows.unionByName(marker, allowMissingColumns=True), path, COHORT_PARTITION
    )


def delete_cohort_range(spark: SparkSession, path: str, low: int, high: int) -> list[int]:
    """Empty the cohorts with ``low <= id <= high``; returns the ids that were there."""
    ids = [
        r[0]
        for r in spark.read.schema(struct_type(COHORT_DDL))
        .parquet(path)
        .where(F.col(COHORT_PARTITION).between(low, high))
        .select(COHORT_PARTITION)
        .distinct()
        .collect()
    ]
    if ids:
        empty = spark.createDataFrame([], struct_type(COHORT_DDL))
        write_cohorts(empty, path, ids)
    return sorted(ids)


def result_columns(df: DataFrame) -> DataFrame:
    """The fixed projection of a summary table."""
    return conform(df, IR_SUMMARY_DDL)


def write_summary(df: DataFrame, path: str) -> None:
    """The summary of a run in place of an earlier run's, so a run can be repeated."""
    swap_table(result_columns(df), path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The tasks that earlier runs recorded, or None before the first."""
    settle_table(spark, path)
    return spark.read.parquet(path) if exists(spark, path) else None


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and snake case column names."""
    rename_all(df, snake_case).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of ``write_csv`` back under the names and types it had."""
    stored = T.StructType([T.StructField(snake_case(f.name), f.dataType) for f in schema])
    return spark.read.option("header", True).schema(stored).csv(path).toDF(*schema.names)


def save_incremental(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Put the rows of ``df`` in place of those of the same key in an exported CSV table.

    The new table is complete before the old one goes, and the same call again changes nothing.
    """
    spark = df.sparkSession
    settle_table(spark, path)
    before = read_csv(spark, path, df.schema) if exists(spark, path) else None
    swap_table(df if before is None else keyed_replace(before, df, key), path, write_csv)


def read_site_files(
    spark: SparkSession, pattern: str, spec: Sequence[FieldSpec]
) -> DataFrame:
    """All sites' CSV files of one table, every field as text, with file and record number.

    Types are the specification's business (``coerce_types``), so nothing is guessed.  Each
    file's own header decides its columns; optional columns a file lacks are NULL.  A file is
    one partition of a ``RecordFiles`` scan, which keeps quoted line breaks.
    """
    files = csv_files(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    headers = record_files(spark, files, [], headers=True)
    layouts = headers.groupBy("header").agg(F.min("path").alias("example")).orderBy("example").collect()
    names: list[str] = []
    for header, example in layouts:
        check_names(header, spec, example)
        names += [c for c in header if c not in names]
    rows = record_files(spark, files, names)
    first = layouts[0].header if layouts else []
    return rows.select(*first, SITE_FILE, SITE_LINE, *[c for c in names if c not in first])


def merge_site_files(
    spark: SparkSession, pattern: str, spec: Sequence[FieldSpec], unique: bool = False
) -> DataFrame:
    """Read, coerce and merge; ``unique`` also drops repeated keys within a file."""
    rows = coerce_types(read_site_files(spark, pattern, spec), spec)
    key = primary_key(spec)
    rows = first_file_wins(rows, key) if key else rows
    rows = drop_duplicate_keys(rows, key, [SITE_FILE, SITE_LINE]) if unique and key else rows
    return rows.drop(SITE_LINE)


def merged_sites(
    spark: SparkSession, pattern: str, spec: Sequence[FieldSpec], unique: bool = False
) -> DataFrame:
    """``merge_site_files``, merged once for as long as files and specification stay the same."""
    files = csv_files(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    definition = ["merged", [repr(f) for f in spec], unique]
    return reused(
        "sites", [spark.read.text(files)], definition, lambda: merge_site_files(spark, pattern, spec, unique)
    )


def append_results(
    new: DataFrame, path: str, spec: Sequence[FieldSpec], overwrite: bool | None = None
) -> None:
    """Add rows to a plain result table; keys both sides have are settled by ``split_conflicts``.

    Old rows that must give way make a rewrite necessary, after which the tables are swapped;
    otherwise this appends.  All columns of the specification are kept, those that one side
    lacks as NULL; a stored column outside the specification is an error.  ``append_keyed`` does
    the same for tables laid out by key, of which it rewrites only what changes.
    """
    spark = new.sparkSession
    key = primary_key(spec)
    rows = fill_key_nulls(coerce_types(check_columns(new, spec), spec), spec)
    order = [c for c in (SITE_FILE, SITE_LINE) if c in new.columns]
    rows = all_fields(drop_duplicate_keys(rows, key, order), spec)
    settle_table(spark, path)
    existing = spark.read.parquet(path)
    if unknown := sorted(set(existing.columns) - {f.name for f in spec}):
        raise ColumnMismatch(f"{path} holds columns outside the specification: {', '.join(unknown)}")
    kept, added = split_conflicts(all_fields(existing, spec), rows, key, overwrite)
    replaces = "database_id" in key if overwrite is None else overwrite
    if replaces or len(existing.columns) < len(spec):  # files of fewer columns would hide the new ones
        swap_table(kept.unionByName(added), path)
    else:
        added.write.mode("append").parquet(path)


def replace_site(df: DataFrame, path: str) -> None:
    """Replace all rows of the databases in ``df``; the table is partitioned by database."""
    _replace_partitions(df, path, "database_id")
