from __future__ import annotations

import json

import pytest

from days import frame, plain
from spanrate.operators.cohort import batches, build_cohorts, events_with_mask
from spanrate.operators.subgroups import age_sex_subgroups
from spanrate.operators.vocabulary import resolve_concept_sets
from spanrate.plans.recipes import (
    clean_condition,
    clean_condition_during_visit,
    concepts,
    earliest_infection,
    on_calendar_days,
)
from spanrate.schemas import CLINICAL_DDL
from spanrate.sources.clinical import ClinicalTables
from spanrate.sources.settings import cohort_from_json
from spanrate.specs import (
    CohortSpec,
    Comparison,
    ConceptItem,
    ConceptSet,
    Criterion,
    Group,
    Rule,
    SpecError,
    families,
)


def tables(spark, conditions=(), measurements=(), visits=(), periods=((1, 1, 1, 2000),), persons=()):
    """Rows: condition (person, concept, start, end); measurement (person, concept, day,
    value concept); visit (person, concept, start, end); period (id, person, start, end)."""
    rows = {
        "person": persons,
        "observation_period": periods,
        "condition_occurrence": [
            (i, p, c, s, e, None) for i, (p, c, s, e) in enumerate(conditions)
        ],
        "measurement": [
            (i, p, c, d, 1.0, v, None, None, None) for i, (p, c, d, v) in enumerate(measurements)
        ],
        "visit_occurrence": [(i, p, c, s, e) for i, (p, c, s, e) in enumerate(visits)],
        "concept": [(c, None) for c in range(1, 10)] + [(20, "D"), (21, "D"), (22, None)],
        "concept_ancestor": [(5, 6), (5, 21), (5, 22), (5, 5), (20, 20)],
        "vocabulary": [],
    }
    return ClinicalTables(**{n: frame(spark, rows[n], CLINICAL_DDL[n]) for n in rows})


def built(cdm, *specs):
    return plain(build_cohorts(cdm, specs))


def test_invalid_concepts_count_when_listed_but_not_as_descendants(spark):
    cdm = tables(spark)
    sets = [
        (1, ConceptSet(1, (ConceptItem(5, True), ConceptItem(20)))),
        (1, ConceptSet(2, (ConceptItem(5, True), ConceptItem(5, True, True)))),
        (2, ConceptSet(1, (ConceptItem(5, True), ConceptItem(6, False, True)))),
        (2, ConceptSet(2, (ConceptItem(99),))),
    ]
    found = plain(resolve_concept_sets(cdm.concept, cdm.concept_ancestor, sets))
    assert found == [(1, 1, 5), (1, 1, 6), (1, 1, 20), (1, 1, 22), (2, 1, 5), (2, 1, 22)]


def test_clean_window_and_observation_period(spark):
    # The event on day 60 follows one 10 days earlier, which only counts outside the period
    # if the period is ignored.
    conditions = [(1, 1, 50, None), (1, 1, 60, None), (1, 1, 200, None)]
    cdm = tables(spark, conditions, periods=[(1, 1, 55, 300)])
    assert built(cdm, clean_condition(7, "", concepts(1), 30)) == [(7, 1, 200, 201)]
    inside = clean_condition(7, "", concepts(1), 30, ignore_period=False)
    assert built(cdm, inside) == [(7, 1, 60, 61), (7, 1, 200, 201)]


def test_exit_is_cut_at_the_end_of_observation_and_periods_collapse(spark):
    conditions = [(1, 1, d, None) for d in (10, 12, 13, 20)]
    cdm = tables(spark, conditions, periods=[(1, 1, 1, 21)])
    spec = CohortSpec(3, (Criterion("condition", 1),), "", (ConceptSet(1, concepts(1)),), exit_offset=2)
    assert built(cdm, spec) == [(3, 1, 10, 15), (3, 1, 20, 21)]


def test_specs_that_differ_by_codes_and_days_are_one_family(spark):
    specs = [
        clean_condition(1, "a", concepts(1), 30),
        clean_condition(2, "b", concepts(2, 3), 183, exit_offset=4),
        clean_condition(3, "c", concepts(1), 5),
        clean_condition(4, "d", concepts(1), 30, ignore_period=False),
    ]
    assert [f.cohort_ids for f in families(specs)] == [(1, 2, 3), (4,)]
    conditions = [(p, c, d, None) for p in (1, 2) for c in (1, 2, 3) for d in (10 * p, 17 * c, 90, 150)]
    cdm = tables(spark, conditions, periods=[(1, 1, 1, 400), (2, 2, 1, 151)])
    together = built(cdm, *specs)
    assert together == sorted(r for s in specs for r in built(cdm, s))
    assert {r[0] for r in together} == {1, 2, 3, 4}


def test_only_conditions_during_a_visit_count(spark):
    spec = clean_condition_during_visit(5, "", concepts(1), concepts(9), 100)
    conditions = [(1, 1, 50, None), (1, 1, 80, None), (1, 1, 120, None)]
    # Day 80 has no visit, so it neither enters nor breaks the window of day 120.
    visits = [(1, 9, 49, 50), (1, 9, 120, 125), (1, 8, 80, 80)]
    assert built(tables(spark, conditions, visits=visits), spec) == [(5, 1, 50, 51)]
    assert built(tables(spark, conditions[1:], visits=visits), spec) == [(5, 1, 120, 121)]


def test_earliest_infection_voids_diagnoses_with_a_negative_test(spark):
    spec = earliest_infection(
        6, "", concepts(2), concepts(1), [8], [9], Comparison("gt", "2000-01-31")
    )
    periods = [(p, p, 1, 3000) for p in (1, 2, 3, 4)]
    conditions = [(1, 1, 500, None), (2, 1, 500, None), (3, 1, 300, None), (3, 1, 600, None)]
    measurements = [(2, 2, 502, 9), (2, 2, 700, 8), (4, 2, 500, 8), (4, 2, 20, 8)]
    # 2: the negative test voids day 500, the positive one on day 700 enters.
    # 3: First is taken before the rules, and day 300 lacks a year of observation.
    # 4: an earlier positive test, whatever its date, rules the person out.
    assert built(tables(spark, conditions, measurements, periods=periods), spec) == [
        (6, 1, 500, 503),
        (6, 2, 700, 703),
    ]


def test_calendar_days(spark):
    periods = [(1, 1, 1, 800), (2, 2, 200, 800)]
    spec = on_calendar_days(9, "", ["2001-01-01", "2002-01-01"])
    # Day 367 is 2001-01-01: one year after day 1, but not after day 200.
    assert built(tables(spark, periods=periods), spec) == [(9, 1, 367, 367), (9, 1, 732, 732), (9, 2, 732, 732)]


def test_rule_masks(spark):
    present = lambda c: Group("ALL", (_near(c),))
    spec = CohortSpec(
        4,
        (Criterion("condition", 1),),
        "",
        tuple(ConceptSet(i, concepts(i)) for i in (1, 2, 3)),
        rules=(Rule("two", present(2)), Rule("three", present(3))),
    )
    conditions = [(1, 1, 10, None), (1, 2, 10, None), (1, 1, 30, None), (1, 2, 30, None)]
    conditions += [(1, 3, 30, None), (1, 1, 50, None)]
    ((merged, batch),) = batches(tables(spark, conditions), [spec])
    masks = plain(events_with_mask(batch, merged), "start_date", "rule_mask", "n_rules", "first_rule")
    assert masks == [(10, 1, 1, 0), (30, 3, 2, 0), (50, 0, 0, 0)]
    assert built(tables(spark, conditions), spec) == [(4, 1, 30, 30)]


def _near(codeset):
    from spanrate.specs import Correlated, Window

    return Correlated(Criterion("condition", codeset), Window(-1, 1))


def test_subgroups_enter_and_leave_bands_on_calendar_years(spark):
    cdm = tables(spark, periods=[(1, 1, 1, 1200)], persons=[(1, 8532, 1995)])
    # Aged 5 in 2000 and 8 in 2003 (day 1200); day 366 is 2000-12-31.
    found = plain(age_sex_subgroups(cdm.person, cdm.observation_period))
    assert found == [(21, 1, 1, 366), (31, 1, 367, 1200), (111, 1, 1, 1200)]


DEFINITION = {
    "ConceptSets": [
        {
            "id": 0,
            "name": "x",
            "expression": {
                "items": [
                    {"concept": {"CONCEPT_ID": 1}, "includeDescendants": True},
                    {"concept": {"CONCEPT_ID": 2}, "isExcluded": True},
                ]
            },
        }
    ],
    "PrimaryCriteria": {
        "CriteriaList": [{"ConditionOccurrence": {"CodesetId": 0, "ConditionTypeExclude": False}}],
        "ObservationWindow": {"PriorDays": 5, "PostDays": 0},
        "PrimaryCriteriaLimit": {"Type": "All"},
    },
    "QualifiedLimit": {"Type": "First"},
    "ExpressionLimit": {"Type": "All"},
    "InclusionRules": [
        {
            "name": "clean",
            "expression": {
                "Type": "ALL",
                "CriteriaList": [
                    {
                        "Criteria": {"ConditionOccurrence": {"CodesetId": 0}},
                        "StartWindow": {
                            "Start": {"Days": 30, "Coeff": -1},
                            "End": {"Days": 1, "Coeff": -1},
                            "UseEventEnd": False,
                        },
                        "Occurrence": {"Type": 0, "Count": 0, "IsDistinct": False},
                        "IgnoreObservationPeriod": True,
                    }
                ],
                "Groups": [],
                "DemographicCriteriaList": [],
            },
        }
    ],
    "EndStrategy": {"DateOffset": {"DateField": "StartDate", "Offset": 1}},
    "CensoringCriteria": [],
    "CensorWindow": {},
    "CollapseSettings": {"CollapseType": "ERA", "EraPad": 0},
}


def test_definition_from_json_equals_the_recipe(spark):
    spec = cohort_from_json(8, json.dumps(DEFINITION))
    assert spec.prior_days == 5
    (rule,) = spec.rules
    (test,) = rule.group.criteria
    assert (test.window.start, test.window.end, test.kind, test.count) == (-30, -1, "exactly", 0)
    conditions = [(1, 1, 4, None), (1, 1, 40, None), (1, 2, 80, None), (1, 1, 90, None)]
    # A qualified limit without additional criteria has no effect.
    assert built(tables(spark, conditions), spec) == [(8, 1, 40, 41), (8, 1, 90, 91)]


@pytest.mark.parametrize(
    "change",
    [
        {"CensoringCriteria": [{"Death": {}}]},
        {"EndStrategy": {"CustomEra": {}}},
        {"PrimaryCriteria": {**DEFINITION["PrimaryCriteria"], "CriteriaList": [{"DrugExposure": {}}]}},
        {
            "PrimaryCriteria": {
                **DEFINITION["PrimaryCriteria"],
                "CriteriaList": [{"ConditionOccurrence": {"CodesetId": 0, "Age": {"Op": "gt", "Value": 5}}}],
            }
        },
    ],
)
def test_what_cannot_be_evaluated_is_refused(change):
    with pytest.raises(SpecError):
        cohort_from_json(8, json.dumps({**DEFINITION, **change}))


def test_undefined_concept_sets_are_refused():
    with pytest.raises(SpecError):
        CohortSpec(1, (Criterion("condition", 4),), "", (ConceptSet(1, concepts(1)),))
