"""From the merged results of several databases to pooled tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.disclosure import apply_censoring, min_cell
from ..operators.report import (
    fold_outcome,
    label_strata,
    pivot_age_sex,
    recode,
    stack_by_sex,
    subgroup_reference,
)
from ..operators.statistics import (
    exact_ratios,
    pool_rates,
    pool_ratios,
    recovered_events,
    standardised_strata,
    standardised_totals,
)

AGE_GROUPS = ["0 - 5", "6 - 17", "18 - 34", "35 - 54", "55 - 64", "65 - 74", "75 - 84", "85 - 114"]
SEXES = ["Male", "Female"]
POOL_KEYS = [
    "target_cohort_definition_id",
    "time_at_risk_id",
    "outcome_cohort_definition_id",
    "subgroup_cohort_definition_id",
]


@dataclass(frozen=True)
class Fold:
    """A second definition of an outcome that is reported under the first."""

    old_id: int
    new_id: int
    old_name: str
    new_name: str


def clean_results(
    results: DataFrame,
    site_names: Mapping[str, str],
    allowed: DataFrame,
    blocked: DataFrame,
    folds: Sequence[Fold] = (),
) -> DataFrame:
    """Small cells hidden again, sites renamed, censoring applied, strata labelled."""
    out = recode(min_cell(results), site_names, ["database_name"])
    out = label_strata(apply_censoring(out, allowed, blocked))
    for f in folds:
        out = fold_outcome(out, f.old_id, f.new_id, f.old_name, f.new_name)
    return out.distinct()


def meta_analysis(
    results: DataFrame,
    target_ids: Sequence[int],
    tar_ids: Sequence[int],
    outcome_ids: Sequence[int],
) -> DataFrame:
    """Pooled rates of the sex by age strata (subgroup ids 21 to 99)."""
    cells = recovered_events(results).where(
        F.col("target_cohort_definition_id").isin(*target_ids)
        & F.col("time_at_risk_id").isin(*tar_ids)
        & F.col("outcome_cohort_definition_id").isin(*outcome_ids)
        & F.col("subgroup_cohort_definition_id").between(21, 99)
        & (F.col("num_persons_at_risk") > 0)
        & (F.col("person_years") > 0)
    )
    return pool_rates(cells, POOL_KEYS, "uncensored_outcomes", "person_years")


def age_sex_table(results: DataFrame, pooled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wide table of pooled rates, the same as text with one row per outcome and sex)."""
    names = results.select("outcome_cohort_definition_id", "outcome_name").distinct()
    named = pooled.join(names, "outcome_cohort_definition_id", "left").join(
        subgroup_reference(results).drop("subgroup_name"), "subgroup_cohort_definition_id", "left"
    )
    values = {"pe": "rate", "lb": "rate_predict_lower", "ub": "rate_predict_upper"}
    wide = pivot_age_sex(named, AGE_GROUPS, SEXES, values)
    return wide, stack_by_sex(wide, AGE_GROUPS, SEXES)


def ratio_analysis(
    results: DataFrame,
    target_ids: Sequence[int],
    comparator_ids: Sequence[int],
    tar_ids: Sequence[int],
    subgroup_ids: Sequence[int],
) -> tuple[DataFrame, DataFrame]:
    """(standardised ratios per database, ratios pooled over databases)."""
    ratios = exact_ratios(
        standardised_totals(
            standardised_strata(results, target_ids, comparator_ids, tar_ids, subgroup_ids)
        )
    )
    return ratios, pool_ratios(ratios)
