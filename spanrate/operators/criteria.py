"""Windowed presence and absence of events around index days, and groups of such tests.

What a test says about an index event depends on its start date and observation period only,
so tests run on *anchors*: distinct (owner, start_date, op_start, op_end).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import plus_days
from ..specs import Correlated, Days, Group
from .events import OWNER, CohortBatch, event_days, within_observation
from .intervals import count_in_boxes, count_in_windows, latest_end_before, match_points

ANCHOR = ["start_date", "op_start", "op_end"]


def anchors_of(
    batch: CohortBatch,
    events: DataFrame,
    owner: Sequence[str] = OWNER,
    prior_days: int = 0,
    post_days: int = 0,
) -> DataFrame:
    """Distinct index days of ``events`` with their observation periods."""
    days = events.select(*owner, "start_date").distinct()
    return within_observation(batch, days, prior_days, post_days).select(*owner, *ANCHOR).distinct()


def shifted(column: str, days: Days) -> Column:
    """``column`` plus days, which may depend on the cohort of the row."""
    if isinstance(days, int):
        return plus_days(column, days)
    per_cohort = F.create_map(
        *[x for cohort, n in days.days for x in (F.lit(cohort).cast("long"), F.lit(n))]
    )
    return plus_days(column, F.element_at(per_cohort, F.col("cohort_definition_id")))


def _bounds(test: Correlated) -> tuple[Column, Column]:
    """Allowed candidate start days of ``test``, clipped to the index observation period."""
    low = high = F.lit(None).cast("date")
    if test.window.start is not None:
        low = shifted("start_date", test.window.start)
    if test.window.end is not None:
        high = shifted("start_date", test.window.end)
    if not test.ignore_observation_period:
        low = F.greatest(low, F.col("op_start"))
        high = F.least(high, F.col("op_end"))
    return low, high


def _end_bounds(test: Correlated) -> tuple[Column, Column]:
    low = high = F.lit(None).cast("date")
    if test.end_window.start is not None:
        low = shifted("start_date", test.end_window.start)
    elif not test.ignore_observation_period:
        low = F.col("op_start")
    if test.end_window.end is not None:
        high = shifted("start_date", test.end_window.end)
    elif not test.ignore_observation_period:
        high = F.col("op_end")
    return low, high


def _is_presence(test: Correlated) -> bool:
    return (test.kind, test.count) in (("at_least", 1), ("exactly", 0), ("at_most", 0))


def _holds(test: Correlated, n: Column) -> Column:
    if test.kind == "at_least":
        return n >= test.count
    return n == test.count if test.kind == "exactly" else n <= test.count


def _by_part(tests: dict[int, Correlated], column_of) -> Column:
    """One column that holds, per row, the expression of the row's own test."""
    cases = [F.when(F.col("test") == i, column_of(t)) for i, t in tests.items()]
    return F.coalesce(*cases)


def counted(
    batch: CohortBatch,
    anchors: DataFrame,
    tests: Sequence[Correlated],
    owner: Sequence[str] = OWNER,
) -> DataFrame:
    """(owner, anchor, test, n_events): how many candidates each test finds per anchor.

    Tests with a start window only share one timeline.  A test that asks whether some event
    began early enough and ended late enough keeps the latest end; any other combination of
    a start and an end window counts day boxes.
    """
    owner = list(owner)
    numbered = dict(enumerate(tests))
    plain = {i: t for i, t in numbered.items() if t.end_window is None}
    reach = {
        i: t
        for i, t in numbered.items()
        if t.end_window is not None
        and t.window.start is None
        and t.end_window.end is None
        and t.window.end is not None
        and t.end_window.start is not None
        and _is_presence(t)
    }
    boxes = {i: t for i, t in numbered.items() if i not in plain and i not in reach}
    outer = [c for c in owner if c not in OWNER]
    results = []

    def of(chosen: dict[int, Correlated]) -> tuple[DataFrame, DataFrame]:
        """The anchors once per test, and the candidates of each test.

        Candidates belong to the cohort, whatever outer criterion the anchors stem from.
        """
        events = event_days(batch, [(i, t.criterion) for i, t in chosen.items()])
        ids = ", ".join(map(str, chosen))
        return (
            anchors.selectExpr("*", f"explode(array({ids})) AS test"),
            events.withColumnRenamed("part", "test"),
        )

    if plain:
        mine, candidates = of(plain)
        results.append(
            count_in_windows(
                mine,
                candidates,
                [*OWNER, "test"],
                [*outer, *ANCHOR],
                "start_date",
                _by_part(plain, lambda t: _bounds(t)[0]),
                _by_part(plain, lambda t: _bounds(t)[1]),
                "n",
            )
        )
    for in_period in (True, False):
        chosen = {i: t for i, t in reach.items() if t.ignore_observation_period != in_period}
        if not chosen:
            continue
        mine, candidates = of(chosen)
        keys = [*OWNER, "test"]
        rest = [*outer, *ANCHOR]
        if in_period:
            spans = mine.select(*keys, "op_start", "op_end").distinct()
            candidates = match_points(
                candidates, spans, keys, "start_date", "op_start", "op_end", 1827
            ).where(F.col("end_date") <= F.col("op_end"))
            keys = [*keys, "op_start", "op_end"]
            rest = [*outer, "start_date"]
        latest = latest_end_before(
            mine,
            candidates,
            keys,
            rest,
            "start_date",
            "end_date",
            _by_part(chosen, lambda t: shifted("start_date", t.window.end)),
        )
        needed = _by_part(chosen, lambda t: shifted("start_date", t.end_window.start))
        results.append(
            latest.withColumn(
                "n_events", F.coalesce((F.col("latest_end") >= needed).cast("long"), F.lit(0))
            ).drop("latest_end")
        )
    for i, test in boxes.items():
        mine, candidates = of({i: test})
        window = test.end_window
        bounded = isinstance(window.start, int) and isinstance(window.end, int)
        results.append(
            count_in_boxes(
                mine,
                candidates,
                [*OWNER, "test"],
                [*outer, *ANCHOR],
                "start_date",
                "end_date",
                _bounds(test),
                _end_bounds(test),
                max(1, window.end - window.start + 1) if bounded else None,
                "n",
            )
        )
    columns = [*owner, *ANCHOR, "test", F.col("n_events").cast("long").alias("n_events")]
    return reduce(DataFrame.unionByName, [r.select(*columns) for r in results])




def _leaves(group: Group) -> list[Correlated]:
    found = list(group.criteria)
    for inner in group.groups:
        found += _leaves(inner)
    return list(dict.fromkeys(found))


def _predicate(group: Group, column_of: dict[Correlated, str]) -> Column:
    parts = [_holds(t, F.col(column_of[t])) for t in group.criteria]
    parts += [_predicate(g, column_of) for g in group.groups]
    return reduce((lambda a, b: a & b) if group.kind == "ALL" else (lambda a, b: a | b), parts)


def evaluated(
    batch: CohortBatch,
    anchors: DataFrame,
    groups: Sequence[Group],
    owner: Sequence[str] = OWNER,
) -> tuple[DataFrame, list[Column]]:
    """Every anchor with the counts of all tests in ``groups``, and one predicate per group.

    However deep the groups nest, their tests are counted together and brought to one row
    per anchor; the groups are then boolean expressions over that row.
    """
    owner = list(owner)
    tests = list(dict.fromkeys(t for g in groups for t in _leaves(g)))
    found = counted(batch, anchors, tests, owner)
    column_of = {t: f"_n{i}" for i, t in enumerate(tests)}
    if len(tests) == 1:
        wide = found.withColumnRenamed("n_events", "_n0").drop("test")
    else:
        wide = found.groupBy(*owner, *ANCHOR).agg(
            *[F.expr(f"max(CASE WHEN test = {i} THEN n_events END) AS _n{i}") for i in range(len(tests))]
        )
    return wide, [_predicate(g, column_of) for g in groups]


def satisfying(
    batch: CohortBatch,
    anchors: DataFrame,
    group: Group,
    owner: Sequence[str] = OWNER,
) -> DataFrame:
    """The anchors that meet ``group``: all of its tests, or any of them."""
    wide, (holds,) = evaluated(batch, anchors, [group], owner)
    return wide.where(holds).select(*owner, *ANCHOR)
