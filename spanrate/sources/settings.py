"""Study settings from CSV and JSON files.  They are small and read by the driver."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..schemas import camel_case, snake_case, struct_type
from ..specs import (
    Analysis,
    CohortSpec,
    Comparison,
    ConceptItem,
    ConceptSet,
    Correlated,
    Criterion,
    Group,
    OutcomeSpec,
    Rule,
    SpecError,
    SubgroupSpec,
    TargetSpec,
    TarSpec,
    Window,
)
from .durable import read_text


def read_settings(path: str | Path) -> list[dict[str, str | None]]:
    """Rows of a settings CSV, by column name; empty fields are None."""
    with open(path, newline="", encoding="utf-8") as f:
        return parse_settings(f)


def parse_settings(lines: Iterable[str]) -> list[dict[str, str | None]]:
    return [{k: (v or None) for k, v in row.items()} for row in csv.DictReader(lines)]


def settings_text(spark: SparkSession, path: str) -> str:
    """A settings file in any file system that Spark reads."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    return text


def settings_rows(spark: SparkSession, path: str) -> list[dict[str, str | None]]:
    return parse_settings(settings_text(spark, path).splitlines())


def read_settings_frame(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(struct_type(ddl)).option("header", True).csv(path)


def target_specs(rows: list[dict[str, Any]]) -> list[TargetSpec]:
    return [TargetSpec(int(r["cohortId"]), r["cohortName"]) for r in rows]


def tar_specs(rows: list[dict[str, Any]]) -> list[TarSpec]:
    names = ("id", "start_offset", "start_index", "end_offset", "end_index")
    return [TarSpec(*(int(r[f"time_at_risk_{n}"]) for n in names)) for r in rows]


def outcome_specs(rows: list[dict[str, Any]]) -> list[OutcomeSpec]:
    """Columns may be written in camel or snake case."""
    specs = []
    for raw in rows:
        r = {snake_case(camel_case(k) if "_" in k else k): v for k, v in raw.items()}

        def whole(name: str, row=r) -> int | None:
            return int(row[name]) if row.get(name) not in (None, "", "NA") else None

        specs.append(
            OutcomeSpec(
                outcome_id=int(r["outcome_id"]),
                outcome_cohort_definition_id=int(r["outcome_cohort_definition_id"]),
                outcome_name=r["outcome_name"],
                clean_window=whole("clean_window") or 0,
                excluded_cohort_definition_id=whole("excluded_cohort_definition_id"),
                primary_time_at_risk_start_offset=whole("primary_time_at_risk_start_offset"),
                primary_time_at_risk_start_index=whole("primary_time_at_risk_start_index"),
                primary_time_at_risk_end_offset=whole("primary_time_at_risk_end_offset"),
                primary_time_at_risk_end_index=whole("primary_time_at_risk_end_index"),
            )
        )
    return specs


def subgroup_specs(rows: list[dict[str, Any]]) -> list[SubgroupSpec]:
    return [SubgroupSpec(int(r["cohortId"]), r["cohortName"]) for r in rows]


def analyses(text: str) -> list[Analysis]:
    return [
        Analysis(
            a["name"],
            tuple(a["targetIds"]),
            tuple(a["subgroupIds"]),
            tuple(a["timeAtRiskIds"]),
            tuple(a["outcomeIds"]),
        )
        for a in json.loads(text)["analysisList"]
    ]


# Cohort definitions.


def _comparison(node: dict[str, Any] | None) -> Comparison | None:
    if node is None:
        return None
    return Comparison(node["Op"], node["Value"], node.get("Extent"))


def _ids(nodes: list[dict[str, Any]] | None) -> tuple[int, ...]:
    return tuple(n["CONCEPT_ID"] for n in nodes or [])


_DOMAIN_NAMES = {
    "ConditionOccurrence": "condition",
    "Measurement": "measurement",
    "VisitOccurrence": "visit",
    "ObservationPeriod": "observation_period",
}
# Fields a criterion may carry without changing its rows.
_NEUTRAL = {"ConditionTypeExclude", "MeasurementTypeExclude", "VisitTypeExclude"}
_READ = {
    "CodesetId",
    "OccurrenceStartDate",
    "ValueAsNumber",
    "RangeLow",
    "Unit",
    "ValueAsConcept",
    "UserDefinedPeriod",
    "CorrelatedCriteria",
}


def _criterion(node: dict[str, Any]) -> Criterion:
    (name, body), *more = node.items()
    if more or name not in _DOMAIN_NAMES:
        raise SpecError(f"unsupported criterion {list(node)}")
    unknown = {k for k, v in body.items() if v not in (None, False, [], {})} - _READ - _NEUTRAL
    if unknown:
        raise SpecError(f"unsupported attributes {sorted(unknown)} of {name}")
    period = body.get("UserDefinedPeriod")
    nested = body.get("CorrelatedCriteria")
    return Criterion(
        domain=_DOMAIN_NAMES[name],
        codeset_id=body.get("CodesetId"),
        start=_comparison(body.get("OccurrenceStartDate")),
        value=_comparison(body.get("ValueAsNumber")),
        range_low=_comparison(body.get("RangeLow")),
        units=_ids(body.get("Unit")),
        value_concepts=_ids(body.get("ValueAsConcept")),
        on_dates=(period["StartDate"], period["EndDate"]) if period else None,
        nested=_group(nested) if nested else None,
    )


def _edge(node: dict[str, Any]) -> int | None:
    return None if node.get("Days") is None else int(node["Days"]) * int(node["Coeff"])


def _window(node: dict[str, Any] | None, on_end: bool) -> Window | None:
    if not node:
        return None
    if bool(node.get("UseEventEnd")) != on_end or node.get("UseIndexEnd"):
        raise SpecError("a window is on event starts, an end window on event ends")
    return Window(_edge(node["Start"]), _edge(node["End"]))


_OCCURRENCE = {0: "exactly", 1: "at_most", 2: "at_least"}


def _group(node: dict[str, Any]) -> Group:
    if node.get("DemographicCriteriaList"):
        raise SpecError("demographic criteria are not supported")
    tests = []
    for c in node.get("CriteriaList", []):
        if c.get("RestrictVisit") or c["Occurrence"].get("IsDistinct"):
            raise SpecError("visit restriction and distinct counts are not supported")
        tests.append(
            Correlated(
                _criterion(c["Criteria"]),
                _window(c.get("StartWindow"), False) or Window(),
                _window(c.get("EndWindow"), True),
                _OCCURRENCE[c["Occurrence"]["Type"]],
                c["Occurrence"]["Count"],
                bool(c.get("IgnoreObservationPeriod")),
            )
        )
    return Group(node["Type"], tuple(tests), tuple(_group(g) for g in node.get("Groups", [])))


def _concept_set(node: dict[str, Any]) -> ConceptSet:
    items = node["expression"]["items"]
    if any(i.get("includeMapped") for i in items):
        raise SpecError("mapped concepts are not supported")
    return ConceptSet(
        node["id"],
        tuple(
            ConceptItem(
                i["concept"]["CONCEPT_ID"],
                bool(i.get("includeDescendants")),
                bool(i.get("isExcluded")),
            )
            for i in items
        ),
        node.get("name", ""),
    )


def cohort_from_json(cohort_id: int, text: str, name: str = "") -> CohortSpec:
    """A cohort definition in the usual JSON exchange form.

    Anything the engine would have to ignore raises, so a definition is either evaluated as
    written or not at all.
    """
    node = json.loads(text)
    if node.get("CensoringCriteria") or node.get("CensorWindow"):
        raise SpecError("censoring criteria are not supported")
    primary, strategy = node["PrimaryCriteria"], node.get("EndStrategy") or {}
    if strategy and (
        "DateOffset" not in strategy or strategy["DateOffset"]["DateField"] != "StartDate"
    ):
        raise SpecError("only date offsets from the start are supported")
    if not strategy:
        raise SpecError("a cohort needs an end strategy")
    additional = node.get("AdditionalCriteria")
    return CohortSpec(
        cohort_id=cohort_id,
        name=name,
        primary=tuple(_criterion(c) for c in primary["CriteriaList"]),
        concept_sets=tuple(_concept_set(c) for c in node["ConceptSets"]),
        prior_days=primary["ObservationWindow"]["PriorDays"],
        post_days=primary["ObservationWindow"]["PostDays"],
        primary_limit=primary["PrimaryCriteriaLimit"]["Type"],
        additional=_group(additional) if additional else None,
        qualified_limit=node["QualifiedLimit"]["Type"],
        rules=tuple(Rule(r["name"], _group(r["expression"])) for r in node["InclusionRules"]),
        inclusion_limit=node["ExpressionLimit"]["Type"],
        exit_offset=strategy["DateOffset"]["Offset"],
        era_pad=node["CollapseSettings"]["EraPad"],
    )
