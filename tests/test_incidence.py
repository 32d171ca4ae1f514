from __future__ import annotations

import pytest

from days import frame, plain
from spanrate.operators import incidence as I
from spanrate.operators.disclosure import (
    apply_censoring,
    censor_matrix,
    censored_share,
    censored_side,
    min_cell,
)
from spanrate.schemas import COHORT_DDL, literal_frame
from spanrate.specs import Analysis, OutcomeSpec, SpecError, SubgroupSpec, TargetSpec, TarSpec, check_analysis

PERIOD = (
    "observation_period_id long, person_id long, observation_period_start_date date,"
    " observation_period_end_date date"
)


def study(spark, targets, outcomes, subgroups=(), tars=((1, 1, 0, 90, 0),), specs=None, period=(1, 50)):
    persons = {r[1] for r in targets}
    return I.Study(
        frame(spark, [(p, p, *period) for p in persons], PERIOD),
        frame(spark, targets, COHORT_DDL),
        frame(spark, outcomes, COHORT_DDL),
        frame(spark, subgroups, COHORT_DDL),
        I.Settings(
            [TargetSpec(1, "T")],
            [TarSpec(*t) for t in tars],
            [SubgroupSpec(21, "S"), SubgroupSpec(22, "R")],
            specs or [OutcomeSpec(5, 5, "O", 30)],
        ),
        "db",
    )


def row(df, subgroup=0):
    return df.where(f"subgroup_cohort_definition_id = {subgroup}").collect()[0]


def test_windows_are_cut_at_the_end_of_observation(spark):
    s = study(spark, [(1, 1, 10, 10)], [])
    assert plain(s.windows, "start_date", "end_date") == [(11, 50)]


def test_windows_may_hang_on_the_cohort_end(spark):
    s = study(spark, [(1, 1, 10, 20)], [], tars=[(1, 0, 0, 5, 1), (2, -2, 1, 3, 1)])
    assert plain(s.windows, "time_at_risk_id", "start_date", "end_date") == [(1, 10, 25), (2, 18, 23)]


def test_clean_windows_start_the_day_after_the_event(spark):
    rows = frame(spark, [(5, 1, 10, 12), (6, 1, 10, 10)], COHORT_DDL)
    specs = [OutcomeSpec(5, 5, "O", 30), OutcomeSpec(6, 6, "P", 0, excluded_cohort_definition_id=5)]
    found = plain(I.excluded_periods(rows, specs), "outcome_id", "start_date", "end_date")
    assert found == [(5, 11, 40), (6, 10, 12)]


def test_measures_of_one_person(spark):
    # At risk 11..50; the outcome on day 20 excludes 21..50, in which day 30 falls.
    s = study(spark, [(1, 1, 10, 10)], [(5, 1, 20, 21), (5, 1, 30, 31)])
    r = row(s.summary())
    assert (r.num_persons_pre_exclude, r.num_persons_at_risk) == (1, 1)
    assert (r.num_outcomes_pre_exclude, r.num_outcomes) == (2, 1)
    assert (r.num_persons_w_outcome_pre_exclude, r.num_persons_w_outcome) == (1, 1)
    assert (r.person_years, r.incidence_rate_p100py) == (0, None)
    assert r.incidence_proportion_p100p == 100.0
    assert plain(I.excluded_time_cells(s.cells), "excluded_days") == [(29,)]
    assert plain(s.per_person, "days_at_risk", "day_span") == [(40, 39)]


def test_exact_years_keep_small_strata(spark):
    s = study(spark, [(1, 1, 10, 10)], [(5, 1, 20, 21), (5, 1, 30, 31)])
    r = row(s.summary(exact_years=True))
    assert r.person_years == pytest.approx((40 - 29) / 365.25)
    assert r.incidence_rate_p100py == pytest.approx(100 * 1 / ((40 - 29) / 365.25))


def test_a_zero_day_exclusion_uses_up_a_zero_day_era(spark):
    # At risk 50..50, excluded 50..50: both measure 0 days.
    s = study(spark, [(1, 1, 49, 49)], [(5, 1, 49, 49)])
    assert plain(s.eras, "era_start", "era_end") == [(50, 50)]
    assert row(s.summary()).num_persons_at_risk == 0


def test_subgroups_compare_their_time_with_all_excluded_time(spark):
    # Two eras of 10 day steps.  One lies in subgroup 21 and is not excluded, the other is
    # excluded whole: the excluded time equals the time in 21, so the person drops out there.
    targets = [(1, 1, 1, 1), (1, 1, 30, 30)]
    spec = [OutcomeSpec(5, 5, "O", 0, excluded_cohort_definition_id=6)]
    s = study(
        spark,
        targets,
        [(6, 1, 30, 40)],
        [(21, 1, 1, 20)],
        tars=[(1, 0, 0, 10, 0)],
        specs=spec,
    )
    assert row(s.summary()).num_persons_at_risk == 1
    assert row(s.summary(), 21).num_persons_at_risk == 0
    assert row(s.summary(), 22).num_persons_at_risk == 0
    assert row(s.summary(), 22).num_persons_pre_exclude == 0


def test_overlapping_windows_of_a_person_count_once(spark):
    s = study(spark, [(1, 1, 1, 1), (1, 1, 20, 20)], [(5, 1, 25, 25)])
    assert plain(s.eras, "era_start", "era_end") == [(2, 50)]
    assert row(s.summary()).num_outcomes_pre_exclude == 1


def test_a_hot_person_gives_the_same_cells_as_plain_counting(spark):
    # One person holds nearly all outcome rows.
    outcomes = [(5, 1, d, d) for d in range(2, 51)] * 40 + [(5, 2, 30, 30)]
    s = study(spark, [(1, 1, 1, 1), (1, 2, 1, 1)], outcomes, specs=[OutcomeSpec(5, 5, "O", 0)])
    r = row(s.summary())
    assert (r.num_outcomes, r.num_persons_w_outcome) == (49 * 40 + 1, 2)


def test_sites_are_analysed_at_once(spark):
    s = study(spark, [(1, p, 1, 1) for p in (1, 2, 3)], [(5, 1, 20, 20)])
    s.sites = literal_frame(
        spark, [(1, "a"), (2, "b"), (3, "b")], "subject_id long, database_name string"
    )
    found = plain(
        s.summary().where("subgroup_cohort_definition_id = 0"),
        "database_name",
        "num_persons_at_risk",
        "num_outcomes",
    )
    assert found == [("a", 1, 1), ("b", 2, 0)]


def test_settings_are_checked():
    with pytest.raises(SpecError):
        TarSpec(1, 5, 0, 2, 0)
    with pytest.raises(SpecError):
        TarSpec(1, 0, 2, 2, 0)
    with pytest.raises(SpecError):
        OutcomeSpec(1, 2, "x")
    notes = check_analysis(
        Analysis("a", (1,), (), (1, 9), (5,)),
        [TargetSpec(1, "T")],
        [SubgroupSpec(21, "S")],
        [TarSpec(1, 0, 0, 1, 0)],
        [OutcomeSpec(5, 5, "O")],
    )
    assert notes == ["subgroup 21 is not used", "time at risk 9 is not defined"]


def test_min_cell(spark):
    df = literal_frame(spark, [(None,), (0,), (3,), (5,), (-2,)], "n long")
    values = [r.n for r in min_cell(df, ["n"]).collect()]
    assert values == [None, 0, -5, 5, -5]
    share = censored_share(df, ["n"]).collect()[0]
    assert (share.field, share.censored, share.percent) == ("n", 2, 40.0)


def test_censor_matrix_and_lists(spark):
    sheet = literal_frame(
        spark,
        [("x", "No Censorship", None), ("y", "no censorship", "No Censorship")],
        "DB string, `5` string, `6` string",
    )
    free = censored_side(censor_matrix(sheet))
    assert plain(free, "DB", "PHENOTYPE") == [("x", "5"), ("y", "6")]
    results = literal_frame(
        spark,
        [("x", 5, 21), ("x", 6, 21), ("x", 5, 71), ("y", 6, 71)],
        "database_name string, outcome_id long, subgroup_cohort_definition_id long",
    )
    allowed = free.selectExpr("DB AS database_name", "CAST(PHENOTYPE AS BIGINT) AS outcome_id")
    blocked = literal_frame(
        spark, [("x", 71), ("x", 71)], "database_name string, subgroup_cohort_definition_id long"
    )
    kept = apply_censoring(results, allowed.unionByName(allowed), blocked)
    assert plain(kept, "database_name", "outcome_id", "subgroup_cohort_definition_id") == [
        ("x", 5, 21),
        ("y", 6, 71),
    ]


@pytest.mark.parametrize(
    "rows", [[(1, "a"), (2, "a")], [(1, "a"), (2, "a"), (3, "a"), (3, "b")]], ids=["none", "two"]
)
def test_a_person_without_exactly_one_site_stops_the_run(spark, rows):
    s = study(spark, [(1, p, 1, 1) for p in (1, 2, 3)], [(5, 1, 20, 20)])
    s.sites = literal_frame(spark, rows, "subject_id long, database_name string")
    with pytest.raises(Exception, match="not exactly one site for person 3"):
        s.summary().collect()


def test_analyses_built_at_once_equal_each_alone(spark):
    targets = [(t, p, 10 * p, 10 * p + 3) for t in (1, 2) for p in range(1, 9)]
    outcomes = [(o, p, 10 * p + o, 10 * p + o + 1) for o in (5, 6, 7) for p in range(1, 9) if (p + o) % 3]
    groups = [(20 + p % 3, p, 1, 200) for p in range(1, 9)]
    settings = I.Settings(
        [TargetSpec(1, "T"), TargetSpec(2, "U")],
        [TarSpec(i, i, 0, 40, 0) for i in (1, 2, 3)],
        [SubgroupSpec(i, f"S{i}") for i in (20, 21, 22)],
        [OutcomeSpec(i, i, f"O{i}", 30) for i in (5, 6, 7)],
    )
    persons = frame(spark, [(p, p, 1, 200) for p in range(1, 9)], PERIOD)
    frames = [frame(spark, rows, COHORT_DDL) for rows in (targets, outcomes, groups)]
    analyses = [
        Analysis("a", (1,), (20, 21), (1, 2), (5, 6)),
        Analysis("b", (2,), (22,), (2, 3), (7,)),
        Analysis("c", (1, 2), (), (2,), (6,)),
    ]
    alone = [I.incidence(persons, *frames, settings.chosen_by(a), "db") for a in analyses]
    expected = sorted((tuple(r) for f in alone for r in f.collect()), key=str)
    at_once = I.Study(persons, *frames, settings, "db", analyses=analyses)
    assert sorted((tuple(r) for r in at_once.summary().collect()), key=str) == expected
    # Only what an analysis needs is built: no target 2 with window 1, no target 1 with window 3.
    designs = {(r.target_cohort_definition_id, r.time_at_risk_id) for r in at_once.eras.collect()}
    assert designs == {(1, 1), (1, 2), (2, 2), (2, 3)}
    with pytest.raises(ValueError, match="serves 1 to 63"):
        I.Membership(analyses * 30)


def test_persons_are_moved_by_person_only(spark):
    s = study(spark, [(1, 1, 10, 10)], [(5, 1, 20, 21)], subgroups=[(21, 1, 1, 50)])
    plan = s.cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(database_name") == 1  # of the sums
    assert "Exchange hashpartitioning(subject_id#" in plan and "_slot#" not in plan


def test_zero_day_exclusions_count_in_every_era_that_touches(spark):
    # Eras 11..20 and 20..30; the exclusions 15..20 and 20..20 of the first, 20..24 of the second.
    s = study(
        spark,
        [(1, 1, 10, 10), (1, 1, 19, 19)],
        [(6, 1, 15, 20), (6, 1, 20, 24), (5, 1, 20, 20)],
        tars=[(1, 1, 0, 10, 0)],
        specs=[OutcomeSpec(5, 5, "O", 0, excluded_cohort_definition_id=6)],
        period=(1, 30),
    )
    eras = plain(s.eras, "era_start", "era_end")
    found = plain(s.within, "era_start", "era_end", "start_date", "end_date")
    assert sorted(found) == sorted(
        (a, b, c, d) for a, b in eras for c, d in plain(s.excluded, "start_date", "end_date") if a <= c and d <= b
    )
    assert len(found) == len(set(found))
