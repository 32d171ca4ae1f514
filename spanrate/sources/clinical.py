"""The clinical tables a study reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CLINICAL_DDL, conform, struct_type


@dataclass(frozen=True)
class ClinicalTables:
    """Event, person and vocabulary tables with the column names of ``CLINICAL_DDL``."""

    person: DataFrame
    observation_period: DataFrame
    condition_occurrence: DataFrame
    measurement: DataFrame
    visit_occurrence: DataFrame
    concept: DataFrame
    concept_ancestor: DataFrame
    vocabulary: DataFrame | None = None


def read_clinical_files(spark: SparkSession, folder: str, fmt: str = "parquet") -> ClinicalTables:
    """One folder or file set per table, ``<folder>/<table>``."""
    frames = {}
    for name, ddl in CLINICAL_DDL.items():
        reader = spark.read.format(fmt).schema(struct_type(ddl))
        if fmt == "csv":
            reader = reader.option("header", True)
        frames[name] = reader.load(f"{folder}/{name}")
    return ClinicalTables(**frames)


def read_clinical_catalog(
    spark: SparkSession, schema: str, vocabulary_schema: str | None = None
) -> ClinicalTables:
    """Catalog tables, projected to the needed columns and types."""
    vocabulary_tables = ("concept", "concept_ancestor", "vocabulary")
    frames = {}
    for name, ddl in CLINICAL_DDL.items():
        place = vocabulary_schema if vocabulary_schema and name in vocabulary_tables else schema
        frames[name] = conform(spark.table(f"{place}.{name}"), ddl)
    return ClinicalTables(**frames)
