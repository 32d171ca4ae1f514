"""Merging result files of several sites: checks, coercion, keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITE_FILE = "site_file"


@dataclass(frozen=True)
class FieldSpec:
    """One field of a result table; ``type`` is bigint, int, float, varchar or date."""

    name: str
    type: str
    primary_key: bool = False
    optional: bool = False
    empty_is_na: bool = True


class ColumnMismatch(ValueError):
    """A file whose columns are not those of its table."""


# Specification type -> Spark type.
SPARK_TYPES = {
    "bigint": "long",
    "float": "double",
    "int": "int",
    "varchar": "string",
    "date": "date",
}


def spark_type(field: FieldSpec) -> str:
    return SPARK_TYPES[field.type.lower().split("(")[0]]


def check_columns(df: DataFrame, spec: Sequence[FieldSpec], label: str = "table") -> DataFrame:
    """Fail unless the columns are those of the specification; optional ones may be absent."""
    check_names([c for c in df.columns if c != SITE_FILE], spec, label)
    return df


def check_names(names: Sequence[str], spec: Sequence[FieldSpec], label: str) -> None:
    observed = sorted(names)
    expected = sorted(f.name for f in spec if not f.optional or f.name in observed)
    if observed != expected:
        raise ColumnMismatch(
            f"columns of {label} are {', '.join(observed)}; expected {', '.join(expected)}"
        )


def all_fields(df: DataFrame, spec: Sequence[FieldSpec]) -> DataFrame:
    """Exactly the specified columns, NULL where ``df`` has none."""
    have = set(df.columns)
    return df.select(
        *[F.col(f.name) if f.name in have else F.lit(None).cast(spark_type(f)).alias(f.name) for f in spec]
    )


def coerce_types(df: DataFrame, spec: Sequence[FieldSpec]) -> DataFrame:
    """Convert every field to its specified type; a value that does not convert is NULL."""
    casts = {
        f.name: F.col(f.name).try_cast(spark_type(f)) for f in spec if f.name in df.columns
    }
    return df.withColumns(casts)


def coercion_failures(df: DataFrame, spec: Sequence[FieldSpec]) -> DataFrame:
    """Per field, how many values would not convert."""
    names = [f.name for f in spec if f.name in df.columns]
    failed = [
        F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(spark_type(f)).isNull()).alias(
            f.name
        )
        for f in spec
        if f.name in df.columns
    ]
    return df.agg(*failed).unpivot([], names, "field", "failed")


def primary_key(spec: Sequence[FieldSpec]) -> list[str]:
    return [f.name for f in spec if f.primary_key]


def drop_duplicate_keys(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of every key in the given order.

    An aggregate: a key with very many rows shrinks before it is shuffled.
    """
    key, order = list(key), list(order)
    rest = [c for c in df.columns if c not in key and c not in order]
    lead = [c for c in order if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.min(F.struct(*lead, *rest)).alias("_row"))
        .select(*key, "_row.*")
        .select(*df.columns)
    )


def duplicate_key_count(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many rows ``drop_duplicate_keys`` removes."""
    return (
        df.groupBy(*key)
        .agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("removed"))
    )


def first_file_wins(df: DataFrame, key: Sequence[str], file_column: str = SITE_FILE) -> DataFrame:
    """Keep, for every key, the rows of the first file that has it (all of them)."""
    owner = df.groupBy(*key).agg(F.min(file_column).alias(file_column))
    return by_key(df, owner, [*key, file_column], "left_semi")


def by_key(df: DataFrame, keys: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Rows of ``df`` whose key is (or is not) among ``keys``; NULL keys are keys too."""
    same = reduce(
        lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    )
    return df.alias("l").join(keys.select(*key).distinct().alias("r"), same, how)


def append_new_rows(data: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``data`` and the rows of ``new`` whose key it lacks; missing columns become NULL."""
    fresh = by_key(new, data, key, "left_anti")
    return data.unionByName(fresh, allowMissingColumns=True)


def merge_sites(files: Iterable[tuple[str, DataFrame]], spec: Sequence[FieldSpec]) -> DataFrame:
    """Check, coerce and merge the files of one table; the first file wins a shared key."""
    checked = [
        coerce_types(check_columns(df, spec, label), spec).withColumn(SITE_FILE, F.lit(label))
        for label, df in files
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), checked)
    key = primary_key(spec)
    return first_file_wins(merged, key) if key else merged


def fill_key_nulls(df: DataFrame, spec: Sequence[FieldSpec]) -> DataFrame:
    """Empty text and zero for NULLs in fields that may not be missing."""
    strict = [f for f in spec if not f.empty_is_na and f.name in df.columns]
    text = {f.name: "" for f in strict if spark_type(f) == "string"}
    number = {f.name: 0 for f in strict if spark_type(f) in ("long", "double", "int")}
    filled = {**text, **number}
    return df.fillna(filled) if filled else df


def row_to_json(df: DataFrame, column: str = "metadata") -> DataFrame:
    """The whole row as JSON text in one column, unless that column exists."""
    if column in df.columns:
        return df
    return df.withColumn(column, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))


def older_layout(df: DataFrame, table: str) -> DataFrame:
    """Bring tables written by earlier releases to the present columns."""
    if table in ("cohort", "phenotype_description"):
        return row_to_json(df).drop("referent_concept_id")
    if table in ("covariate_value", "temporal_covariate_value") and "sum_value" not in df.columns:
        return df.withColumn("sum_value", F.lit(-1.0))
    return df


def split_conflicts(
    existing: DataFrame, new: DataFrame, key: Sequence[str], overwrite: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows of ``existing`` to keep, rows of ``new`` to add) for keys both sides have.

    New rows replace old ones in tables keyed by database, and give way elsewhere.
    """
    key = list(key)
    replaces = "database_id" in key if overwrite is None else overwrite
    if replaces:
        return by_key(existing, new, key, "left_anti"), new
    return existing, by_key(new, existing, key, "left_anti")
