"""The study the workload runs: cohorts, outcomes, windows."""

from __future__ import annotations

from dataclasses import replace

from spanrate.operators.incidence import Settings
from spanrate.operators.subgroups import subgroup_specs
from spanrate.plans.recipes import (
    TIME_AT_RISK_DAYS,
    absent,
    all_of,
    any_of,
    clean_condition,
    clean_condition_during_visit,
    concepts,
    condition_with_low_value,
    during,
    earliest_infection,
    on_calendar_days,
    present,
)
from spanrate.specs import (
    CohortSpec,
    Comparison,
    ConceptItem,
    ConceptSet,
    Correlated,
    Criterion,
    Group,
    OutcomeSpec,
    Rule,
    TargetSpec,
    TarSpec,
    Window,
)


def priority(n: int) -> tuple[ConceptItem, ...]:
    return concepts(n, descendants=False)


BRANDS_A = concepts(1_000_001, 1_000_002, 1_000_003, 1_000_004, 1_000_005)
BRANDS_B = concepts(1_000_006, 1_000_007, 1_000_008, 1_000_009, 1_000_010)
SETS = (
    ConceptSet(1, priority(1)),
    ConceptSet(2, priority(2)),
    ConceptSet(3, priority(3)),
    ConceptSet(11, BRANDS_A),
    ConceptSet(12, BRANDS_B),
    ConceptSet(21, concepts(9201, 262, descendants=False)),
)

CONDITION_1 = Criterion("condition", 1)
CONDITION_2 = Criterion("condition", 2)
CONDITION_3 = Criterion("condition", 3)
TEST_A = Criterion("measurement", 11)
TEST_B = Criterion("measurement", 12)
LOW_TEST_A = Criterion(
    "measurement",
    11,
    value=Comparison("bt", 10, 30),
    range_low=Comparison("bt", 10, 60),
    units=(1,),
    value_concepts=(1, 3),
    start=Comparison("bt", "1996-01-01", "2000-12-31"),
)
VISIT = Criterion("visit", 21)
PERIOD = Criterion("observation_period")

# Tests around an index event, each with the question it asks.
AT_LEAST_TWO = Correlated(TEST_A, Window(-180, 60), None, "at_least", 2)
NONE_BEFORE = absent(CONDITION_2, Window(-365, -1))
NONE_EVER_BEFORE = absent(TEST_A, Window(None, -1), True)
AT_MOST_ONE = Correlated(TEST_B, Window(None, None), None, "at_most", 1)
DURING_VISIT = during(VISIT)
LONG_VISIT_NEAR = Correlated(VISIT, Window(-20, 10), Window(2, 40), "at_least", 1)
OBSERVED_A_YEAR = present(PERIOD, Window(None, -365), Window(0, None))

GROUP_ALL = all_of(NONE_BEFORE, AT_LEAST_TWO, present(CONDITION_3, Window(-700, 0)))
GROUP_ANY = any_of(LONG_VISIT_NEAR, present(CONDITION_2, Window(-60, 60)), NONE_EVER_BEFORE)
GROUP_NESTED = Group(
    "ALL",
    (OBSERVED_A_YEAR,),
    (any_of(present(TEST_A, Window(-90, 0)), present(TEST_B, Window(-90, 0))), all_of(NONE_BEFORE)),
)
TESTED_CONDITION_2 = Criterion("condition", 2, nested=any_of(present(TEST_A, Window(-200, 200))))
NO_TESTED_CONDITION_BEFORE = absent(TESTED_CONDITION_2, Window(-500, -1), True)

RULES = (
    Rule("observed a year", all_of(OBSERVED_A_YEAR)),
    Rule("no condition 2", all_of(NONE_BEFORE)),
    Rule("tested", any_of(present(TEST_A, Window(-120, 30)), present(TEST_B, Window(-120, 30)))),
)
RULED = CohortSpec(
    301,
    (CONDITION_1, CONDITION_3),
    "conditions 1 and 3 under three rules",
    SETS,
    prior_days=30,
    rules=RULES,
    exit_offset=5,
)
#: The same rules for a cohort whose codes occur nowhere.
RULED_EMPTY = replace(RULED, cohort_id=302, concept_sets=(ConceptSet(1, priority(77)), *SETS[1:2], ConceptSet(3, priority(78)), *SETS[3:]))

CALENDAR = ("1997-01-01", "1998-01-01", "1999-01-01")
TARGET_EVENTS = CohortSpec(
    101, (Criterion("condition", 1),), "Urgent", (ConceptSet(1, priority(1)),), exit_offset=3
)
TARGET_CALENDAR = on_calendar_days(102, "Start of year", CALENDAR)
OUTCOMES = (
    clean_condition(201, "High", priority(2), 30),
    clean_condition(202, "Medium", priority(3), 183),
    clean_condition(203, "Unspecified", priority(4), 183),
    clean_condition(204, "Low", priority(5), 365, ignore_period=False),
)
INPATIENT = concepts(9201, 262, descendants=False)
VISIT_OUTCOME = clean_condition_during_visit(205, "Visited", priority(2), INPATIENT, 365)
VISIT_OUTCOME_HALF_YEAR = clean_condition_during_visit(207, "Visited, 183 days", priority(3), INPATIENT, 183)
POSITIVE, NEGATIVE = (1,), (3,)
INFECTION = earliest_infection(
    103,
    "Earliest",
    BRANDS_A,
    priority(1),
    POSITIVE,
    NEGATIVE,
    Comparison("gt", "1996-06-30"),
)
CONFIRMED = earliest_infection(
    104,
    "Earliest confirmed",
    BRANDS_A + BRANDS_B,
    priority(1),
    POSITIVE,
    NEGATIVE,
    Comparison("bt", "1996-06-30", "2000-06-30"),
    confirmed=True,
)
INFECTION_IN_PERIOD = earliest_infection(
    105,
    "Earliest in a period",
    BRANDS_A,
    priority(1),
    POSITIVE,
    NEGATIVE,
    Comparison("bt", "1997-03-01", "1999-09-30"),
)
LOW_VALUE = condition_with_low_value(
    206,
    "Two part",
    [priority(1), priority(2)],
    BRANDS_A + BRANDS_B,
    priority(3),
    priority(4),
    Comparison("bt", 5, 40),
    (1,),
    (2,),
    Comparison("bt", 10, 60),
    180,
)

TARS = [TarSpec(i, first, 0, last, 0) for i, first, last in TIME_AT_RISK_DAYS]
SETTINGS = Settings(
    targets=[TargetSpec(101, "Urgent"), TargetSpec(102, "Start of year")],
    tars=TARS,
    subgroups=subgroup_specs(),
    outcomes=[
        OutcomeSpec(201, 201, "High", 30),
        OutcomeSpec(202, 202, "Medium", 183),
        OutcomeSpec(203, 203, "Unspecified", 0, excluded_cohort_definition_id=201),
        OutcomeSpec(204, 204, "Low", 365, excluded_cohort_definition_id=202),
    ],
)
STANDARD_SUBGROUPS = [10 * a + g for a in range(2, 10) for g in (1, 2)]


# The exchange format of a cohort, written out for the reader to take back.

_TABLES = {
    "condition": "ConditionOccurrence",
    "measurement": "Measurement",
    "visit": "VisitOccurrence",
    "observation_period": "ObservationPeriod",
}
_KINDS = {"exactly": 0, "at_most": 1, "at_least": 2}


def _comparison_form(c: Comparison | None) -> dict | None:
    if c is None:
        return None
    return {"Op": c.op, "Value": c.value, "Extent": c.extent}


def _concept_form(ids: tuple[int, ...]) -> list[dict]:
    return [{"CONCEPT_ID": i} for i in ids]


def _criterion_form(c: Criterion) -> dict:
    body = {
        "CodesetId": c.codeset_id,
        "OccurrenceStartDate": _comparison_form(c.start),
        "ValueAsNumber": _comparison_form(c.value),
        "RangeLow": _comparison_form(c.range_low),
        "Unit": _concept_form(c.units),
        "ValueAsConcept": _concept_form(c.value_concepts),
        "UserDefinedPeriod": dict(zip(("StartDate", "EndDate"), c.on_dates, strict=True)) if c.on_dates else None,
        "CorrelatedCriteria": _group_form(c.nested) if c.nested else None,
    }
    return {_TABLES[c.domain]: {k: v for k, v in body.items() if v not in (None, [])}}


def _edge_form(days: int | None, open_sign: int) -> dict:
    if days is None:
        return {"Coeff": open_sign}
    return {"Days": abs(days), "Coeff": -1 if days < 0 else 1}


def _window_form(w: Window | None, on_end: bool) -> dict | None:
    if w is None:
        return None
    return {"Start": _edge_form(w.start, -1), "End": _edge_form(w.end, 1), "UseEventEnd": on_end}


def _group_form(g: Group) -> dict:
    tests = [
        {
            "Criteria": _criterion_form(t.criterion),
            "StartWindow": _window_form(t.window, False),
            "EndWindow": _window_form(t.end_window, True),
            "Occurrence": {"Type": _KINDS[t.kind], "Count": t.count},
            "IgnoreObservationPeriod": t.ignore_observation_period,
        }
        for t in g.criteria
    ]
    return {"Type": g.kind, "CriteriaList": tests, "Groups": [_group_form(x) for x in g.groups]}


def exchange_form(spec: CohortSpec) -> dict:
    sets = [
        {
            "id": s.codeset_id,
            "expression": {
                "items": [
                    {
                        "concept": {"CONCEPT_ID": i.concept_id},
                        "includeDescendants": i.descendants,
                        "isExcluded": i.excluded,
                    }
                    for i in s.items
                ]
            },
        }
        for s in spec.concept_sets
    ]
    return {
        "ConceptSets": sets,
        "PrimaryCriteria": {
            "CriteriaList": [_criterion_form(c) for c in spec.primary],
            "ObservationWindow": {"PriorDays": spec.prior_days, "PostDays": spec.post_days},
            "PrimaryCriteriaLimit": {"Type": spec.primary_limit},
        },
        "AdditionalCriteria": _group_form(spec.additional) if spec.additional else None,
        "QualifiedLimit": {"Type": spec.qualified_limit},
        "InclusionRules": [{"name": r.name, "expression": _group_form(r.group)} for r in spec.rules],
        "ExpressionLimit": {"Type": spec.inclusion_limit},
        "EndStrategy": {"DateOffset": {"DateField": "StartDate", "Offset": spec.exit_offset}},
        "CollapseSettings": {"EraPad": spec.era_pad},
    }
