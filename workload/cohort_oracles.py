"""Oracle SQL for the cohort queries: correlated joins over the same clinical views."""

from __future__ import annotations

from .sql import (
    BRANDS_A,
    BRANDS_B,
    CODES,
    FIXTURES,
    GRID,
    MEMBER,
    below,
    coded,
    eras,
    expanded,
    listed,
    statement,
)

BASE = {**FIXTURES, **CODES}
BIG = ("codes", "meas")

IN_PERIOD = "a.s >= i.op_start AND a.s <= i.op_end"


def joined_to_period(events: str, prior: int = 0, post: int = 0) -> str:
    """Events with the observation period that covers them and the required days."""
    return (
        f"SELECT ev.*, op.op_start, op.op_end FROM {events} ev JOIN op"
        f" ON ev.person_id = op.person_id AND ev.s BETWEEN op.op_start AND op.op_end"
        f" WHERE op.op_start + {prior} <= ev.s AND ev.s + {post} <= op.op_end"
    )


def union(*events: str) -> str:
    """Several criteria, numbered by ``part``."""
    return "(" + " UNION ALL ".join(
        f"SELECT CAST({n} AS BIGINT) AS part, * FROM {e} x{n}" for n, e in enumerate(events)
    ) + ")"


def index_of(*events: str, prior: int = 0, post: int = 0) -> str:
    return (
        "SELECT DISTINCT person_id, s, op_start, op_end FROM ("
        + joined_to_period(union(*events), prior, post)
        + ")"
    )


C1, C2, C3 = coded("cond", 1), coded("cond", 2), coded("cond", 3)
A, B = coded("meas", 11), coded("meas", 12)
VISITS = coded("vis", 21)
PERIODS = (
    "(SELECT person_id, person_id AS id, op_start AS s, op_end AS e,"
    " CAST(NULL AS BIGINT) AS visit_id FROM op)"
)


def number(index: str, events: str, condition: str) -> str:
    """Index rows with the count of correlated events."""
    return (
        f"SELECT i.person_id, i.s, i.op_start, i.op_end, COUNT(a.person_id) AS n"
        f" FROM {index} i LEFT JOIN {events} a ON a.person_id = i.person_id AND {condition}"
        f" GROUP BY i.person_id, i.s, i.op_start, i.op_end"
    )


def having(index: str, events: str, condition: str, test: str) -> str:
    return f"(SELECT person_id, s, op_start, op_end FROM ({number(index, events, condition)}) WHERE {test})"


def between(low: int | None, high: int | None, period: bool = True) -> str:
    tests = [IN_PERIOD] if period else []
    if low is not None:
        tests.append(f"a.s >= i.s + ({low})")
    if high is not None:
        tests.append(f"a.s <= i.s + ({high})")
    return " AND ".join(tests) or "TRUE"


DURING = f"{IN_PERIOD} AND a.s <= i.s AND a.e >= i.s AND a.e <= i.op_end"
OBSERVED = f"{IN_PERIOD} AND a.s <= i.s - 365 AND a.e >= i.s AND a.e <= i.op_end"
BOX = f"{between(-20, 10)} AND a.e >= i.s + 2 AND a.e <= i.s + 40"


def every(*groups: str) -> str:
    return "(" + " INTERSECT ".join(f"SELECT * FROM {g} g" for g in groups) + ")"


def some(*groups: str) -> str:
    return "(" + " UNION ".join(f"SELECT * FROM {g} g" for g in groups) + ")"


def nested(events: str, group_of) -> str:
    """Events whose own day meets a group."""
    index = f"(SELECT DISTINCT person_id, s, op_start, op_end FROM ({joined_to_period(events)}))"
    return (
        f"(SELECT ev.* FROM {events} ev WHERE EXISTS (SELECT 1 FROM {group_of(index)} g"
        f" WHERE g.person_id = ev.person_id AND g.s = ev.s))"
    )


IDX = {"idx": index_of(C1, C3)}
INDEX_COLUMNS = "person_id, s AS start_date, op_start, op_end"


def events_sql(*events: str) -> str:
    return statement(
        BASE,
        "SELECT part, person_id, id AS event_id, s AS start_date, e AS end_date,"
        f" visit_id AS visit_occurrence_id FROM {union(*events)}",
        BIG,
    )


def counts_sql(events: str, condition: str) -> str:
    return statement(
        {**BASE, **IDX},
        f"SELECT {INDEX_COLUMNS}, n AS n_events FROM ({number('idx', events, condition)})",
        BIG,
    )


def group_sql(group: str) -> str:
    return statement({**BASE, **IDX}, f"SELECT {INDEX_COLUMNS} FROM {group}", BIG)


EVENT_LIST = (
    "part, person_id, id AS event_id, s AS start_date, e AS end_date,"
    " visit_id AS visit_occurrence_id, op_start, op_end"
)

# The ruled cohort.
RULED = {
    "qualified": joined_to_period(union(C1, C3), 30, 0),
    "ridx": "SELECT DISTINCT person_id, s, op_start, op_end FROM qualified",
    "rule0": f"SELECT * FROM {having('ridx', PERIODS, OBSERVED, 'n >= 1')}",
    "rule1": f"SELECT * FROM {having('ridx', C2, between(-365, -1), 'n = 0')}",
    "rule2": "SELECT * FROM "
    + some(
        having("ridx", A, between(-120, 30), "n >= 1"),
        having("ridx", B, between(-120, 30), "n >= 1"),
    ),
    # A flag per rule and event; masks and ranks are read off the flags.
    "flagged": "SELECT q.*, "
    + ", ".join(
        f"EXISTS (SELECT 1 FROM rule{n} r WHERE r.person_id = q.person_id AND r.s = q.s"
        f" AND r.op_start = q.op_start AND r.op_end = q.op_end) AS met{n}"
        for n in range(3)
    )
    + " FROM qualified q",
    "masked": """
  SELECT *, CAST(list_sum([if(met0, 1, 0), if(met1, 2, 0), if(met2, 4, 0)]) AS BIGINT) AS mask,
         CAST(len(list_filter([met0, met1, met2], lambda m: m)) AS BIGINT) AS n_rules
  FROM flagged""",
    "best": """
  SELECT unnest(arg_max(q, [n_rules, -coalesce(list_position([met0, met1, met2], true), 1),
    DATE '2100-01-01' - s, -part, -id]), max_depth := 2)
  FROM masked q GROUP BY person_id""",
}
RULED_BASE = {**BASE, **RULED}


def ruled_sql(select: str) -> str:
    return statement(RULED_BASE, select, (*BIG, "masked"))


def gain_sql(source: str) -> str:
    """Per rule: met, the only one not met, all."""
    flags = ["met0", "met1", "met2"]
    parts = []
    for n, own in enumerate(flags):
        others = " AND ".join(f for f in flags if f != own)
        parts.append(
            f"SELECT CAST({n} AS BIGINT) AS rule_sequence, count(*) FILTER (WHERE {own}) AS person_count,"
            f" count(*) FILTER (WHERE NOT {own} AND {others}) AS gain_count, count(*) AS person_total"
            f" FROM {source}"
        )
    return ruled_sql(" UNION ALL ".join(parts))


def inclusion_tables_sql() -> str:
    """Both modes' results, rules and summary of the cohort with events, zeros of the other."""
    parts = []
    for mode, source in (("event", "masked"), ("person", "best")):
        head = f"SELECT '{mode}' AS mode, '{{}}' AS \"table\", CAST({{}} AS BIGINT) AS cohort_definition_id"
        parts.append(
            head.format("result", 301) + ", CAST(mask AS BIGINT) AS item, COUNT(*) AS person_count,"
            f" CAST(0 AS BIGINT) AS gain_count, CAST(0 AS BIGINT) AS person_total FROM {source} GROUP BY mask"
        )
        for n in range(3):
            parts.append(
                head.format("rule", 301) + f", {n}, COUNT(*) FILTER (WHERE met{n}),"
                f" COUNT(*) FILTER (WHERE mask = {7 - 2**n}), COUNT(*) FROM {source}"
            )
            parts.append(head.format("rule", 302) + f", {n}, 0, 0, 0")
        parts.append(head.format("summary", 301) + f", 0, COUNT(*) FILTER (WHERE mask = 7), 0, COUNT(*) FROM {source}")
        parts.append(head.format("summary", 302) + ", 0, 0, 0, 0")
    return ruled_sql(" UNION ALL ".join(parts))


def cohort_sql(*parts: tuple[int, str, int]) -> tuple[dict[str, str], str]:
    """(cohort id, index days, exit offset) per cohort: CTEs and the select of their eras."""
    ctes, selects = {}, []
    for cohort_id, days, offset in parts:
        ctes[f"rows{cohort_id}"] = (
            f"SELECT person_id, s, LEAST(s + {offset}, op_end) AS e FROM {days}"
        )
        ctes[f"eras{cohort_id}"] = eras(f"rows{cohort_id}", "person_id", strict=False)
        selects.append(
            f"SELECT CAST({cohort_id} AS BIGINT) AS cohort_definition_id, person_id AS subject_id,"
            f" s AS cohort_start_date, e AS cohort_end_date FROM eras{cohort_id}"
        )
    return ctes, " UNION ALL ".join(selects)


def clean(codeset: int, lookback: int, period: bool = False) -> str:
    events = coded("cond", codeset)
    index = f"({index_of(events)})"
    return having(index, events, between(-lookback, -1, period), "n = 0")


CALENDAR_DAYS = "(" + " UNION ALL ".join(
    f"SELECT person_id, person_id AS id, DATE '{d}' AS s, DATE '{d}' AS e, CAST(NULL AS BIGINT) AS visit_id FROM op"
    f" WHERE DATE '{d}' BETWEEN op_start AND op_end"
    for d in ("1997-01-01", "1998-01-01", "1999-01-01")
) + ")"
CALENDAR = f"({index_of(CALENDAR_DAYS, prior=365)})"
OUTCOME_PARTS = [
    (201, clean(2, 30), 1),
    (202, clean(3, 183), 1),
    (203, clean(4, 183), 1),
    (204, clean(5, 365, True), 1),
]
STUDY_PARTS = [(101, f"({index_of(C1)})", 3), (102, CALENDAR, 0), *OUTCOME_PARTS]


def visited(events: str) -> str:
    return nested(events, lambda index: having(index, VISITS, DURING, "n >= 1"))


VISIT_INDEX = having(f"({index_of(C2)})", VISITS, DURING, "n >= 1")
HALF_YEAR_INDEX = having(f"({index_of(C3)})", VISITS, DURING, "n >= 1")
HALF_YEAR_COHORT = having(HALF_YEAR_INDEX, visited(C3), between(-183, -1, False), "n = 0")
VISIT_COHORT = having(VISIT_INDEX, visited(C2), between(-365, -1, False), "n = 0")


def first_day(days: str) -> str:
    return (
        f"(SELECT person_id, s, op_start, op_end FROM (SELECT *, row_number() OVER ("
        f"PARTITION BY person_id ORDER BY s) AS place FROM {days}) WHERE place = 1)"
    )


def infection(when: str, confirmed: bool = False) -> dict[str, str]:
    tests = 13 if confirmed else 11
    positive = coded("meas", tests, "value_as_concept_id IN (1)")
    negative = coded("meas", tests, "value_as_concept_id IN (3)")
    entry_test = coded("meas", tests, f"value_as_concept_id IN (1) AND {when}")
    entry = coded("cond", 1, when)
    if confirmed:
        void = nested(C1, lambda i: having(i, negative, between(None, None), "n = 0"))
    else:
        entry = nested(entry, lambda i: having(i, negative, between(0, 3), "n = 0"))
        void = nested(C1, lambda i: having(i, negative, between(None, 3, False), "n = 0"))
    rules = {
        "obs": f"SELECT * FROM {having('first_days', PERIODS, OBSERVED, 'n >= 1')}",
        "untested": f"SELECT * FROM {having('first_days', positive, between(None, -1, False), 'n = 0')}",
        "undiagnosed": "SELECT * FROM "
        + having("first_days", void, between(None, -1, not confirmed), "n = 0"),
    }
    if confirmed:
        rules["tested"] = f"SELECT * FROM {having('first_days', positive, between(0, 3), 'n >= 1')}"
    return {
        "first_days": f"SELECT * FROM {first_day('(' + index_of(entry_test, entry) + ')')}",
        **rules,
        "chosen": f"SELECT * FROM {every(*rules)}",
    }


def low_value() -> dict[str, str]:
    unit, earlier_unit, by_range = (
        coded("meas", 13, f"value_as_number BETWEEN 5 AND 40 AND {more}")
        for more in (
            "unit_concept_id IN (1)",
            "unit_concept_id IN (2)",
            "range_low BETWEEN 10 AND 60",
        )
    )
    c4 = coded("cond", 4)
    near, before, lookback = between(-7, 7), between(-90, -7), between(-180, -1)
    low = some(*[having("entry_days", x, near, "n >= 1") for x in (unit, by_range, C3)])
    rest = [having("entry_days", x, before, "n = 0") for x in (earlier_unit, by_range, c4)]
    new = [having("entry_days", x, lookback, "n = 0") for x in (C1, C2)]
    return {
        "entry_days": index_of(C1, C2),
        "low_now": f"SELECT * FROM {low}",
        "chosen": f"SELECT * FROM {every('low_now', *rest, *new)}",
    }


def built(parts, before: dict[str, str] | None = None) -> str:
    ctes, select = cohort_sql(*parts)
    return statement({**BASE, **(before or {}), **ctes}, select, BIG)


def oracles() -> dict[str, str]:
    resolve = "SELECT CAST(7 AS BIGINT) AS cohort_definition_id, codeset_id, concept_id FROM ("
    resolve += " UNION ALL ".join(
        f"(({kept}) EXCEPT ({gone}))" if gone else f"({kept})"
        for kept, gone in [
            (expanded(1, *BRANDS_A) + " UNION " + listed(1, 17), expanded(1, 1000003)),
            (expanded(2, *BRANDS_B) + " UNION " + listed(2, 1, 2, 3, 5, 8), None),
            (expanded(3, 1000011, 1000012), expanded(3, 1000012)),
            (listed(4, 1000013, 1000014) + " UNION " + below(4, 1000014), None),
        ]
    )
    low_a = coded(
        "meas",
        11,
        "value_as_number BETWEEN 10 AND 30 AND range_low BETWEEN 10 AND 60"
        " AND unit_concept_id IN (1) AND value_as_concept_id IN (1, 3)"
        " AND s BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
    )
    one_day = (
        "(SELECT person_id, person_id AS id, DATE '1998-01-01' AS s, DATE '1998-01-01' AS e,"
        " CAST(NULL AS BIGINT) AS visit_id FROM op WHERE DATE '1998-01-01' BETWEEN op_start AND op_end)"
    )
    tested_2 = nested(C2, lambda i: having(i, A, between(-200, 200), "n >= 1"))
    full = "(SELECT person_id, s, op_start, op_end FROM masked WHERE mask = 7)"
    era_rows = {"era_rows": "SELECT person_id, s, e FROM cond"}
    member = (
        "SELECT CAST(subgroup_id AS BIGINT) AS cohort_definition_id, subject_id,"
        f" s AS cohort_start_date, e AS cohort_end_date FROM ({MEMBER})"
    )
    sql = {
        "concept_set_resolve": statement(FIXTURES, resolve + ")"),
        "criterion_condition": events_sql(C1, coded("cond", 2, "s > DATE '1997-06-30'")),
        "criterion_measurement": events_sql(low_a, B),
        "criterion_visit": events_sql(VISITS),
        "criterion_obs_period": events_sql(PERIODS, one_day),
        "primary_events_all": statement(
            BASE, f"SELECT {EVENT_LIST} FROM ({joined_to_period(union(C1, A), 180, 30)})", BIG
        ),
        "primary_events_first": statement(
            BASE,
            f"SELECT {EVENT_LIST} FROM (SELECT *, row_number() OVER (PARTITION BY person_id"
            f" ORDER BY s, part, id) AS place FROM ({joined_to_period(union(C1, A))}))"
            " WHERE place = 1",
            BIG,
        ),
        "event_ordinals": statement(
            BASE,
            "SELECT person_id, id AS event_id, s AS start_date, row_number() OVER ("
            "PARTITION BY person_id ORDER BY s, id, part) AS ordinal"
            f" FROM ({joined_to_period(union(C1, C2))})",
            BIG,
        ),
        "correlated_at_least": counts_sql(A, between(-180, 60)),
        "correlated_none": counts_sql(C2, between(-365, -1)),
        "correlated_ignore_op": counts_sql(A, between(None, -1, False)),
        "correlated_open_window": counts_sql(B, between(None, None)),
        "correlated_end_window": group_sql(having("idx", VISITS, DURING, "n >= 1")),
        "correlated_box": counts_sql(VISITS, BOX),
        "group_all": group_sql(
            every(
                having("idx", C2, between(-365, -1), "n = 0"),
                having("idx", A, between(-180, 60), "n >= 2"),
                having("idx", C3, between(-700, 0), "n >= 1"),
            )
        ),
        "group_any": group_sql(
            some(
                having("idx", VISITS, BOX, "n >= 1"),
                having("idx", C2, between(-60, 60), "n >= 1"),
                having("idx", A, between(None, -1, False), "n = 0"),
            )
        ),
        "group_nested": group_sql(
            every(
                having("idx", PERIODS, OBSERVED, "n >= 1"),
                some(
                    having("idx", A, between(-90, 0), "n >= 1"),
                    having("idx", B, between(-90, 0), "n >= 1"),
                ),
                having("idx", C2, between(-365, -1), "n = 0"),
            )
        ),
        "criterion_nested": counts_sql(tested_2, between(-500, -1, False)),
        "inclusion_mask": ruled_sql(
            "SELECT person_id, id AS event_id, s AS start_date, mask AS rule_mask,"
            " n_rules AS rules_met FROM masked"
        ),
        "inclusion_result": ruled_sql(
            "SELECT CAST(301 AS BIGINT) AS cohort_definition_id, mask AS inclusion_rule_mask,"
            " COUNT(*) AS person_count FROM masked GROUP BY mask"
        ),
        "inclusion_gain": gain_sql("masked"),
        "inclusion_summary": ruled_sql(
            "SELECT CAST(301 AS BIGINT) AS cohort_definition_id, COUNT(*) AS base_count,"
            " CAST(SUM(CASE WHEN mask = 7 THEN 1 ELSE 0 END) AS BIGINT) AS final_count FROM masked"
        ),
        "inclusion_result_person": ruled_sql(
            "SELECT CAST(301 AS BIGINT) AS cohort_definition_id, mask AS inclusion_rule_mask,"
            " COUNT(*) AS person_count FROM best GROUP BY mask"
        ),
        "inclusion_summary_person": ruled_sql(
            "SELECT CAST(301 AS BIGINT) AS cohort_definition_id, COUNT(*) AS base_count,"
            " COUNT(*) FILTER (WHERE met0 AND met1 AND met2) AS final_count FROM best"
        ),
        "inclusion_with_empty_cohort": ruled_sql(
            " UNION ALL ".join(
                f"SELECT CAST(301 AS BIGINT) AS cohort_definition_id, CAST({n} AS INTEGER) AS rule_sequence,"
                f" COUNT(*) FILTER (WHERE met{n}) AS person_count,"
                f" COUNT(*) FILTER (WHERE mask = {7 - 2**n}) AS gain_count, COUNT(*) AS person_total FROM masked"
                f" UNION ALL SELECT 302, {n}, 0, 0, 0"
                for n in range(3)
            )
        ),
        "inclusion_tables": inclusion_tables_sql(),
        "best_event": ruled_sql(
            "SELECT person_id, id AS event_id, s AS start_date, mask AS rule_mask FROM best"
        ),
        "best_event_gain": gain_sql("best"),
        "cohort_exit": ruled_sql(
            "SELECT DISTINCT person_id, s AS start_date, LEAST(s + 5, op_end) AS end_date, op_end"
            f" FROM {full}"
        ),
        "cohort_ruled": built([(301, full, 5)], RULED),
        "cohort_era_collapse": statement(
            {**FIXTURES, **era_rows},
            "SELECT person_id, s AS start_date, e AS end_date FROM ("
            + eras("era_rows", "person_id", False, 30)
            + ")",
        ),
        "cohort_clean_windows": built(OUTCOME_PARTS),
        "cohort_visit_condition": built([(205, VISIT_COHORT, 1)]),
        "cohort_earliest_event": built([(103, "chosen", 3)], infection("s > DATE '1996-06-30'")),
        "cohort_earliest_in_period": built(
            [(105, "chosen", 3)], infection("s BETWEEN DATE '1997-03-01' AND DATE '1999-09-30'")
        ),
        "cohort_visit_half_year": built([(207, HALF_YEAR_COHORT, 1)]),
        "cohort_earliest_confirmed": built([(104, "chosen", 3)], infection("s BETWEEN DATE '1996-06-30' AND DATE '2000-06-30'", True)),
        "cohort_calendar_days": built([(102, CALENDAR, 0)]),
        "cohort_low_value": built([(206, "chosen", 1)], low_value()),
        "cohort_union": built(STUDY_PARTS),
        "subgroup_membership": statement({**FIXTURES, "grid": GRID}, member),
        "subgroup_sizes": statement(
            {**FIXTURES, "grid": GRID, "member": member},
            """
SELECT CAST(g.subgroup_id AS BIGINT) AS subgroup_cohort_definition_id, g.name AS subgroup_name,
       m.num_persons, m.days_observed
FROM grid g LEFT JOIN (
  SELECT cohort_definition_id, COUNT(DISTINCT subject_id) AS num_persons,
         CAST(SUM(cohort_end_date - cohort_start_date + 1) AS BIGINT) AS days_observed
  FROM member GROUP BY cohort_definition_id) m ON m.cohort_definition_id = g.subgroup_id""",
        ),
    }
    # Cohorts read from JSON are the cohorts themselves.
    names = [
        "clean_windows",
        "visit_condition",
        "visit_half_year",
        "earliest_event",
        "earliest_in_period",
        "earliest_confirmed",
        "calendar_days",
        "low_value",
        "ruled",
    ]
    return {**sql, **{f"json_{n}": sql[f"cohort_{n}"] for n in names}}
