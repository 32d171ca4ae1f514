"""Fixed schemas of the frames that cross module borders, and naming helpers."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


COHORT_DDL = (
    "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"
)
EVENT_COLUMNS = [
    "person_id",
    "event_id",
    "start_date",
    "end_date",
    "visit_occurrence_id",
    "sort_date",
]
COHORT_COLUMNS = ["cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date"]

IR_SUMMARY_DDL = """
  database_name string,
  target_cohort_definition_id long, target_name string,
  time_at_risk_id long,
  time_at_risk_start_offset long, time_at_risk_start_index long,
  time_at_risk_end_offset long, time_at_risk_end_index long,
  subgroup_cohort_definition_id long, subgroup_name string,
  outcome_id long, outcome_cohort_definition_id long, outcome_name string, clean_window long,
  num_persons_pre_exclude long, num_persons_at_risk long,
  person_years_pre_exclude long, person_years long,
  num_persons_w_outcome_pre_exclude long, num_persons_w_outcome long,
  num_outcomes_pre_exclude long, num_outcomes long,
  incidence_proportion_p100p double, incidence_rate_p100py double
"""

CLINICAL_DDL = {
    "person": "person_id long, gender_concept_id long, year_of_birth int",
    "observation_period": (
        "observation_period_id long, person_id long,"
        " observation_period_start_date date, observation_period_end_date date"
    ),
    "condition_occurrence": (
        "condition_occurrence_id long, person_id long, condition_concept_id long,"
        " condition_start_date date, condition_end_date date, visit_occurrence_id long"
    ),
    "measurement": (
        "measurement_id long, person_id long, measurement_concept_id long, measurement_date date,"
        " value_as_number double, value_as_concept_id long, unit_concept_id long,"
        " range_low double, visit_occurrence_id long"
    ),
    "visit_occurrence": (
        "visit_occurrence_id long, person_id long, visit_concept_id long,"
        " visit_start_date date, visit_end_date date"
    ),
    "concept": "concept_id long, invalid_reason string",
    "concept_ancestor": "ancestor_concept_id long, descendant_concept_id long",
    "vocabulary": "vocabulary_id string, vocabulary_version string",
}

REFERENCE_DDL = {
    "target_ref": "target_cohort_definition_id long, target_name string",
    "outcome_ref": (
        "outcome_id long, outcome_cohort_definition_id long, outcome_name string,"
        " clean_window int, primary_time_at_risk_start_offset long,"
        " primary_time_at_risk_start_index int, primary_time_at_risk_end_offset long,"
        " primary_time_at_risk_end_index int, excluded_cohort_definition_id long"
    ),
    "subgroup_ref": "subgroup_cohort_definition_id long, subgroup_name string",
    "time_at_risk": (
        "time_at_risk_id long, time_at_risk_start_offset long, time_at_risk_start_index int,"
        " time_at_risk_end_offset long, time_at_risk_end_index int"
    ),
}


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project ``df`` to exactly the columns and types of ``ddl``."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct_type(ddl)])


_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "date": pa.date32(),
}


def literal_frame(spark: SparkSession, rows: Sequence[Sequence[Any]], ddl: str) -> DataFrame:
    """A DataFrame of driver-side settings (never of data).

    The Arrow route gives Catalyst a local relation with a known size.
    """
    schema = struct_type(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    table = pa.table(
        {
            f.name: pa.array(list(values), type=_ARROW[f.dataType.simpleString()])
            for f, values in zip(schema, columns, strict=True)
        }
    )
    return spark.createDataFrame(table, schema=schema)


def fan_out(df: DataFrame, rows: Sequence[Sequence[Any]], ddl: str) -> DataFrame:
    """Every row of ``df`` once per settings row, without a join.

    The settings travel as one literal.
    """
    names = [f.name for f in struct_type(ddl)]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return df.select("*", F.inline(F.from_json(F.lit(text), f"array<struct<{ddl}>>")))


def snake_case(name: str) -> str:
    """numOutcomes -> num_outcomes, incidenceRateP100py -> incidence_rate_p_100py."""
    spaced = re.sub(r"(?=[A-Z])", "_", name).lower()
    return re.sub(r"(?<=[a-z])(?=[0-9])", "_", spaced)


def camel_case(name: str) -> str:
    head, *rest = name.lower().split("_")
    return head + "".join(part[:1].upper() + part[1:] for part in rest)


def rename_all(df: DataFrame, rule) -> DataFrame:
    return df.select(*[F.col(c).alias(rule(c)) for c in df.columns])
