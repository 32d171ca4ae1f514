"""The cohort shapes of a safety study, with the codes left to the caller.

Concept sets are passed as tuples of concept items; dates and windows are the study's.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..specs import (
    CohortSpec,
    Comparison,
    ConceptItem,
    ConceptSet,
    Correlated,
    Criterion,
    Group,
    Rule,
    Window,
)

Items = Sequence[ConceptItem]


def concepts(*ids: int, descendants: bool = True, without: Sequence[int] = ()) -> tuple:
    kept = tuple(ConceptItem(i, descendants) for i in ids)
    return kept + tuple(ConceptItem(i, descendants, excluded=True) for i in without)


def absent(criterion: Criterion, window: Window, ignore_period: bool = False) -> Correlated:
    return Correlated(criterion, window, None, "exactly", 0, ignore_period)


def present(criterion: Criterion, window: Window, end_window: Window | None = None) -> Correlated:
    return Correlated(criterion, window, end_window)


def all_of(*tests: Correlated) -> Group:
    return Group("ALL", tests)


def any_of(*tests: Correlated) -> Group:
    return Group("ANY", tests)


def clean_condition(
    cohort_id: int,
    name: str,
    condition: Items,
    lookback: int = 365,
    ignore_period: bool = True,
    exit_offset: int = 1,
) -> CohortSpec:
    """Every occurrence of a condition with none of the same in the ``lookback`` days before."""
    entry = Criterion("condition", 1)
    clean = absent(entry, Window(-lookback, -1), ignore_period)
    return CohortSpec(
        cohort_id,
        (entry,),
        name,
        (ConceptSet(1, tuple(condition)),),
        rules=(Rule("clean window", all_of(clean)),),
        exit_offset=exit_offset,
    )


# A visit that starts on or before the index day, ends on or after it, within observation.
def during(visit: Criterion) -> Correlated:
    return present(visit, Window(None, 0), Window(0, None))


def clean_condition_during_visit(
    cohort_id: int,
    name: str,
    condition: Items,
    visits: Items,
    lookback: int = 365,
    exit_offset: int = 1,
) -> CohortSpec:
    """The same for conditions diagnosed during a visit; only such conditions break the window."""
    visit = Criterion("visit", 2)
    earlier = Criterion("condition", 1, nested=all_of(during(visit)))
    return CohortSpec(
        cohort_id,
        (Criterion("condition", 1),),
        name,
        (ConceptSet(1, tuple(condition)), ConceptSet(2, tuple(visits))),
        additional=all_of(during(visit)),
        rules=(Rule("clean window", all_of(absent(earlier, Window(-lookback, -1), True))),),
        exit_offset=exit_offset,
    )


def observed_before(days: int = 365) -> Correlated:
    """At least ``days`` of observation before the index day."""
    return present(Criterion("observation_period"), Window(None, -days), Window(0, None))


def earliest_infection(
    cohort_id: int,
    name: str,
    tests: Items,
    diagnoses: Items,
    positive: Sequence[int],
    negative: Sequence[int],
    period: Comparison,
    confirmed: bool = False,
    exit_offset: int = 3,
) -> CohortSpec:
    """First positive test or diagnosis of a person in ``period``.

    Unconfirmed, a diagnosis counts unless a negative test follows within 3 days, and an
    earlier one rules the person out unless a negative test came by its day 3.  Confirmed,
    every diagnosis may be the entry, a positive test must follow within 3 days, and an
    earlier diagnosis is void with a negative test at any time in its observation period.
    """
    positive_test = Criterion("measurement", 1, value_concepts=tuple(positive))
    negative_test = Criterion("measurement", 1, value_concepts=tuple(negative))
    entry_test = Criterion("measurement", 1, start=period, value_concepts=tuple(positive))
    if confirmed:
        entry_diagnosis = Criterion("condition", 2, start=period)
        void = any_of(absent(negative_test, Window()))
    else:
        entry_diagnosis = Criterion(
            "condition", 2, start=period, nested=any_of(absent(negative_test, Window(0, 3)))
        )
        void = any_of(absent(negative_test, Window(None, 3), True))
    first_of_kind = all_of(
        absent(positive_test, Window(None, -1), True),
        absent(Criterion("condition", 2, nested=void), Window(None, -1), confirmed),
    )
    rules = [Rule("observed", all_of(observed_before())), Rule("first infection", first_of_kind)]
    if confirmed:
        rules.append(Rule("positive test", all_of(present(positive_test, Window(0, 3)))))
    return CohortSpec(
        cohort_id,
        (entry_test, entry_diagnosis),
        name,
        (ConceptSet(1, tuple(tests)), ConceptSet(2, tuple(diagnoses))),
        primary_limit="First",
        rules=tuple(rules),
        inclusion_limit="First",
        exit_offset=exit_offset,
    )


def on_calendar_days(
    cohort_id: int, name: str, days: Sequence[str], prior_days: int = 365
) -> CohortSpec:
    """Persons observed on the given days and for ``prior_days`` before."""
    return CohortSpec(
        cohort_id,
        tuple(Criterion("observation_period", on_dates=(d, d)) for d in days),
        name,
        prior_days=prior_days,
        exit_offset=0,
    )


def condition_with_low_value(
    cohort_id: int,
    name: str,
    conditions: Sequence[Items],
    test: Items,
    diagnosis: Items,
    earlier_diagnosis: Items,
    value: Comparison,
    units: Sequence[int],
    earlier_units: Sequence[int],
    range_low: Comparison,
    lookback: int = 365,
    exit_offset: int = 1,
) -> CohortSpec:
    """Any of several conditions together with a newly low measurement.

    Low means a value in range by unit, or by the reference range, or a diagnosis, within 7
    days of the index; none of these in the 90 to 7 days before; and none of the conditions
    in the lookback.
    """
    n = len(conditions)
    by_unit = Criterion("measurement", n + 1, value=value, units=tuple(units))
    earlier_by_unit = Criterion("measurement", n + 1, value=value, units=tuple(earlier_units))
    by_range = Criterion("measurement", n + 1, value=value, range_low=range_low)
    diagnosed = Criterion("condition", n + 2)
    earlier_diagnosed = Criterion("condition", n + 3)
    near, before = Window(-7, 7), Window(-90, -7)
    low_now = any_of(*[present(c, near) for c in (by_unit, by_range, diagnosed)])
    not_low_before = all_of(
        *[absent(c, before) for c in (earlier_by_unit, by_range, earlier_diagnosed)]
    )
    entries = tuple(Criterion("condition", i + 1) for i in range(n))
    clean = all_of(*[absent(c, Window(-lookback, -1)) for c in entries])
    sets = [*conditions, test, diagnosis, earlier_diagnosis]
    return CohortSpec(
        cohort_id,
        entries,
        name,
        tuple(ConceptSet(i + 1, tuple(items)) for i, items in enumerate(sets)),
        rules=(
            Rule("newly low", Group("ALL", (), (low_now, not_low_before))),
            Rule("clean window", clean),
        ),
        exit_offset=exit_offset,
    )


# Days at risk, all counted from cohort start.
TIME_AT_RISK_DAYS = [(1, 0, 2), (2, 1, 7), (3, 1, 14), (4, 1, 21), (5, 1, 28), (6, 1, 90), (7, 1, 365)]
