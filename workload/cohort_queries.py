"""Queries over concept sets, criteria and cohorts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrate.operators import cohort as C
from spanrate.operators.criteria import ANCHOR, anchors_of, counted, satisfying
from spanrate.operators.events import CohortBatch, criterion_events
from spanrate.operators.incidence import subgroup_frame
from spanrate.operators.subgroups import age_sex_subgroups, subgroup_specs
from spanrate.operators.vocabulary import resolve_concept_sets
from spanrate.sources.durable import durable
from spanrate.sources.settings import cohort_from_json
from spanrate.specs import (
    CohortSpec,
    Comparison,
    ConceptItem,
    ConceptSet,
    Correlated,
    Criterion,
    Group,
)

from . import definitions as D
from .clinical import clinical

Query = Callable[[SparkSession, str], DataFrame]
EVENTS = ["person_id", "event_id", "start_date", "end_date", "visit_occurrence_id"]


def batch_of(spark: SparkSession, sf_dir: str, sets: tuple[ConceptSet, ...] = D.SETS) -> CohortBatch:
    cdm = clinical(spark, sf_dir)
    codes = resolve_concept_sets(cdm.concept, cdm.concept_ancestor, [(0, s) for s in sets])
    return CohortBatch(cdm, (0,), durable(codes))


def batch_for(spark: SparkSession, sf_dir: str, spec: CohortSpec) -> tuple[CohortSpec, CohortBatch]:
    return C.batches(clinical(spark, sf_dir), [spec])[0]


def concept_set_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    cdm = clinical(spark, sf_dir)
    sets = [
        ConceptSet(1, D.BRANDS_A + (ConceptItem(1_000_003, True, True), ConceptItem(17))),
        ConceptSet(2, D.BRANDS_B + D.concepts(1, 2, 3, 5, 8, descendants=False)),
        ConceptSet(3, D.concepts(1_000_011, 1_000_012, without=(1_000_012,))),
        ConceptSet(4, (ConceptItem(1_000_013), ConceptItem(1_000_014, True))),
    ]
    resolved = resolve_concept_sets(cdm.concept, cdm.concept_ancestor, [(7, s) for s in sets])
    return resolved.select("cohort_definition_id", "codeset_id", "concept_id")


def events_query(*criteria: Criterion) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = list(enumerate(criteria))
        return criterion_events(batch_of(spark, sf_dir), parts).select(
            F.col("part").cast("long").alias("part"), *EVENTS
        )

    return run


def primary_query(limit: str, prior: int, post: int, *criteria: Criterion) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = C.primary_events(batch_of(spark, sf_dir), criteria, prior, post, limit)
        return events.select(
            F.col("part").cast("long").alias("part"), *EVENTS, "op_start", "op_end"
        )

    return run


def event_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = batch_of(spark, sf_dir)
    events = C.primary_events(batch, [D.CONDITION_1, D.CONDITION_2])
    return C.event_ordinals(events).select("person_id", "event_id", "start_date", "ordinal")


def index_days(batch: CohortBatch) -> DataFrame:
    return anchors_of(batch, criterion_events(batch, [(0, D.CONDITION_1), (1, D.CONDITION_3)]))


def counts_query(test: Correlated) -> Query:
    """Every index day with the number of events its window holds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        batch = batch_of(spark, sf_dir)
        return counted(batch, index_days(batch), [test]).select("person_id", *ANCHOR, "n_events")

    return run


def group_query(group: Group) -> Query:
    """The index days that meet a group."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        batch = batch_of(spark, sf_dir)
        return satisfying(batch, index_days(batch), group).select("person_id", *ANCHOR)

    return run


def cohort_query(*specs: CohortSpec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.build_cohorts(clinical(spark, sf_dir), specs)

    return run


def cohort_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and outcome cohorts, built apart, as one table."""
    cdm = clinical(spark, sf_dir)
    targets = C.build_cohorts(cdm, [D.TARGET_EVENTS, D.TARGET_CALENDAR])
    return C.cohort_union(targets, C.build_cohorts(cdm, D.OUTCOMES))


def inclusion_result_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons per rule mask, each by their best event."""
    return C.inclusion_result(C.best_event_per_person(ruled_events(spark, sf_dir)))


def inclusion_summary_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = C.best_event_per_person(ruled_events(spark, sf_dir))
    return C.inclusion_summary(best, len(D.RULES), [D.RULED.cohort_id])


def inclusion_with_empty_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cohorts under the same rules; the one no event enters has its rows too, all zero."""
    specs = [D.RULED, D.RULED_EMPTY]
    events = [C.events_with_mask(b, s) for s, b in C.batches(clinical(spark, sf_dir), specs)]
    both = events[0] if len(events) == 1 else events[0].unionByName(events[1])
    return C.inclusion_stats(both, len(D.RULES), [s.cohort_id for s in specs])


def inclusion_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inclusion tables of both cohorts and modes from one pass over their events."""
    specs = [D.RULED, D.RULED_EMPTY]
    events = [C.events_with_mask(b, s) for s, b in C.batches(clinical(spark, sf_dir), specs)]
    both = events[0] if len(events) == 1 else events[0].unionByName(events[1])
    return C.inclusion_tables(both, len(D.RULES), [s.cohort_id for s in specs])


def json_query(*specs: CohortSpec) -> Query:
    """The same cohorts from their definitions in the exchange format."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = {s.cohort_id: json.dumps(D.exchange_form(s)) for s in specs}
        read = [cohort_from_json(i, text) for i, text in texts.items()]
        return C.build_cohorts(clinical(spark, sf_dir), read)

    return run


def ruled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, batch = batch_for(spark, sf_dir, D.RULED)
    return C.events_with_mask(batch, spec)


def inclusion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled_events(spark, sf_dir).select(
        "person_id", "event_id", "start_date", "rule_mask", F.col("n_rules").alias("rules_met")
    )


def inclusion_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.inclusion_result(ruled_events(spark, sf_dir))


def inclusion_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = C.inclusion_stats(ruled_events(spark, sf_dir), len(D.RULES), [D.RULED.cohort_id])
    return stats.select(
        F.col("rule_sequence").cast("long").alias("rule_sequence"),
        "person_count",
        "gain_count",
        "person_total",
    )


def inclusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.inclusion_summary(ruled_events(spark, sf_dir), len(D.RULES), [D.RULED.cohort_id])


def best_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_event_per_person(ruled_events(spark, sf_dir)).select(
        "person_id", "event_id", "start_date", "rule_mask"
    )


def best_event_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = C.best_event_per_person(ruled_events(spark, sf_dir))
    return C.inclusion_stats(best, len(D.RULES), [D.RULED.cohort_id]).select(
        F.col("rule_sequence").cast("long").alias("rule_sequence"),
        "person_count",
        "gain_count",
        "person_total",
    )


def cohort_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, batch = batch_for(spark, sf_dir, D.RULED)
    return C.cohort_exits(C.included_anchors(batch, spec), spec.exit_offset).select(
        "person_id", "start_date", "end_date", "op_end"
    )


def era_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition periods of all codes merged per person, with gaps up to 30 days closed."""
    condition = clinical(spark, sf_dir).condition_occurrence
    rows = condition.select(
        F.lit(1).cast("long").alias("cohort_definition_id"),
        "person_id",
        F.col("condition_start_date").alias("start_date"),
        F.coalesce(
            "condition_end_date", F.date_add("condition_start_date", 1)
        ).alias("end_date"),
    )
    return C.collapse(rows, era_pad=30).select("person_id", "start_date", "end_date")


def subgroup_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    cdm = clinical(spark, sf_dir)
    return age_sex_subgroups(cdm.person, cdm.observation_period)


def subgroup_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and observed days per labelled subgroup."""
    members = subgroup_membership(spark, sf_dir)
    names = subgroup_frame(spark, subgroup_specs())
    days = F.datediff("cohort_end_date", "cohort_start_date") + 1
    sizes = members.groupBy(F.col("cohort_definition_id").alias("subgroup_cohort_definition_id")).agg(
        F.countDistinct("subject_id").alias("num_persons"),
        F.sum(days.cast("long")).alias("days_observed"),
    )
    return F.broadcast(names).join(sizes, "subgroup_cohort_definition_id", "left")


def queries() -> dict[str, Query]:
    period_days = Criterion("observation_period", on_dates=("1998-01-01", "1998-01-01"))
    return {
        "concept_set_resolve": concept_set_resolve,
        "criterion_condition": events_query(
            D.CONDITION_1, Criterion("condition", 2, start=Comparison("gt", "1997-06-30"))
        ),
        "criterion_measurement": events_query(D.LOW_TEST_A, D.TEST_B),
        "criterion_visit": events_query(D.VISIT),
        "criterion_obs_period": events_query(D.PERIOD, period_days),
        "primary_events_all": primary_query("All", 180, 30, D.CONDITION_1, D.TEST_A),
        "primary_events_first": primary_query("First", 0, 0, D.CONDITION_1, D.TEST_A),
        "event_ordinals": event_ordinals,
        "correlated_at_least": counts_query(D.AT_LEAST_TWO),
        "correlated_none": counts_query(D.NONE_BEFORE),
        "correlated_ignore_op": counts_query(D.NONE_EVER_BEFORE),
        "correlated_open_window": counts_query(D.AT_MOST_ONE),
        "correlated_end_window": group_query(Group("ALL", (D.DURING_VISIT,))),
        "correlated_box": counts_query(D.LONG_VISIT_NEAR),
        "group_all": group_query(D.GROUP_ALL),
        "group_any": group_query(D.GROUP_ANY),
        "group_nested": group_query(D.GROUP_NESTED),
        "criterion_nested": counts_query(D.NO_TESTED_CONDITION_BEFORE),
        "inclusion_mask": inclusion_mask,
        "inclusion_result": inclusion_result,
        "inclusion_gain": inclusion_gain,
        "inclusion_summary": inclusion_summary,
        "inclusion_result_person": inclusion_result_person,
        "inclusion_summary_person": inclusion_summary_person,
        "inclusion_with_empty_cohort": inclusion_with_empty_cohort,
        "inclusion_tables": inclusion_tables,
        "best_event": best_event,
        "best_event_gain": best_event_gain,
        "cohort_exit": cohort_exit,
        "cohort_ruled": cohort_query(D.RULED),
        "cohort_era_collapse": era_collapse,
        "cohort_clean_windows": cohort_query(*D.OUTCOMES),
        "cohort_visit_condition": cohort_query(D.VISIT_OUTCOME),
        "cohort_visit_half_year": cohort_query(D.VISIT_OUTCOME_HALF_YEAR),
        "cohort_earliest_in_period": cohort_query(D.INFECTION_IN_PERIOD),
        "cohort_earliest_event": cohort_query(D.INFECTION),
        "cohort_earliest_confirmed": cohort_query(D.CONFIRMED),
        "cohort_calendar_days": cohort_query(D.TARGET_CALENDAR),
        "cohort_low_value": cohort_query(D.LOW_VALUE),
        "cohort_union": cohort_union,
        "json_clean_windows": json_query(*D.OUTCOMES),
        "json_visit_condition": json_query(D.VISIT_OUTCOME),
        "json_visit_half_year": json_query(D.VISIT_OUTCOME_HALF_YEAR),
        "json_earliest_in_period": json_query(D.INFECTION_IN_PERIOD),
        "json_earliest_event": json_query(D.INFECTION),
        "json_earliest_confirmed": json_query(D.CONFIRMED),
        "json_calendar_days": json_query(D.TARGET_CALENDAR),
        "json_low_value": json_query(D.LOW_VALUE),
        "json_ruled": json_query(D.RULED),
        "subgroup_membership": subgroup_membership,
        "subgroup_sizes": subgroup_sizes,
    }


