"""Oracle SQL for the incidence queries.

Interval unions are self joins. What happens in an era is counted by correlated counts per era and
outcome; persons and cells are sums of those, and the cube is filled by one aggregate.
"""

from __future__ import annotations

from .cohort_oracles import BASE, STUDY_PARTS, cohort_sql
from .sql import FIXTURES, GRID, MEMBER, eras, statement

_cohorts, _select = cohort_sql(*STUDY_PARTS)
COHORTS = {
    **BASE,
    **_cohorts,
    "cohort": _select,
    "target": "SELECT * FROM cohort WHERE cohort_definition_id IN (101, 102)",
    "outcome": "SELECT * FROM cohort WHERE cohort_definition_id NOT IN (101, 102)",
    "grid": GRID,
    "member": MEMBER,
    "tar": """
  SELECT id AS tar_id, CASE id WHEN 1 THEN 0 ELSE 1 END AS first,
         [2, 7, 14, 21, 28, 90, 365][id] AS last
  FROM (SELECT unnest(range(1, 8)) AS id)""",
    "outcome_ref": """
  SELECT 200 + n AS outcome_id, ['High', 'Medium', 'Unspecified', 'Low'][n] AS outcome_name,
         [30, 183, 0, 365][n] AS clean_window
  FROM (SELECT unnest(range(1, 5)) AS n)""",
    "target_ref": "SELECT unnest([101, 102]) AS t, unnest(['Urgent', 'Start of year']) AS target_name",
    # Which cohort's periods block which outcome: days from the start, to a day or to the end.
    "blocks": """
  SELECT outcome_id, outcome_id AS by_cohort, 1 AS from_day, clean_window AS to_day
  FROM outcome_ref WHERE clean_window > 0
  UNION ALL SELECT unnest([203, 204]), unnest([201, 202]), 0, NULL""",
    "exc": """
  SELECT blocks.outcome_id, subject_id, cohort_start_date + CAST(from_day AS INTEGER) AS s,
         coalesce(cohort_start_date + CAST(to_day AS INTEGER), cohort_end_date) AS e
  FROM blocks JOIN outcome ON cohort_definition_id = by_cohort""",
    "ttar": """
  SELECT cohort_definition_id AS t, tar_id AS tar, subject_id,
         least(cohort_start_date + CAST(first AS INTEGER), op_end) AS s,
         least(cohort_start_date + CAST(last AS INTEGER), op_end) AS e
  FROM tar, target JOIN op ON person_id = subject_id
  WHERE cohort_start_date >= op_start AND cohort_start_date <= op_end""",
    "bare_era": eras("ttar", "t, tar, subject_id"),
}
MEASURES = {
    "cut": """
  SELECT db, t, tar, outcome_id AS o, subject_id, greatest(exc.s, era.s) AS s, least(exc.e, era.e) AS e
  FROM era JOIN exc USING (subject_id)
  WHERE greatest(exc.s, era.s) <= least(exc.e, era.e)""",
    "xcl": eras("cut", "db, t, tar, o, subject_id"),
    # What happened in an era, for every outcome: counted per era, whatever the subgroup.
    "fact": """
  SELECT era.*, outcome_id AS o,
         (SELECT count(*) FROM outcome x WHERE x.subject_id = era.subject_id
            AND x.cohort_definition_id = outcome_id AND x.cohort_start_date BETWEEN era.s AND era.e) AS n,
         (SELECT count(*) FROM xcl x WHERE x.db = era.db AND x.t = era.t AND x.tar = era.tar
            AND x.o = outcome_id AND x.subject_id = era.subject_id AND x.s >= era.s AND x.e <= era.e) AS n_blocks,
         (SELECT coalesce(sum(x.e - x.s), 0) FROM xcl x WHERE x.db = era.db AND x.t = era.t
            AND x.tar = era.tar AND x.o = outcome_id AND x.subject_id = era.subject_id
            AND x.s >= era.s AND x.e <= era.e) AS blocked,
         (SELECT count(*) FROM xcl x JOIN outcome y ON y.subject_id = x.subject_id
            AND y.cohort_definition_id = x.o AND y.cohort_start_date BETWEEN x.s AND x.e
            WHERE x.db = era.db AND x.t = era.t AND x.tar = era.tar AND x.o = outcome_id
            AND x.subject_id = era.subject_id AND x.s >= era.s AND x.e <= era.e) AS hidden
  FROM era, outcome_ref""",
    # Eras belong to everybody's subgroup 0 and to those the person is in when they begin.
    "held": """
  SELECT DISTINCT era.subject_id, era.s, subgroup_id AS sg
  FROM era JOIN member m ON m.subject_id = era.subject_id AND era.s BETWEEN m.s AND m.e""",
    "placed": """
  SELECT 0 AS sg, fact.* FROM fact UNION ALL
  SELECT sg, fact.* FROM fact JOIN held USING (subject_id, s)""",
    "personal": """
  SELECT db, t, tar, sg, o, subject_id, sum(e - s) AS span, sum(e - s + 1) AS days, sum(n) AS n,
         sum(n_blocks) AS n_blocks, sum(blocked) AS blocked, sum(hidden) AS hidden
  FROM placed GROUP BY db, t, tar, sg, o, subject_id""",
    "compared_person": """
  SELECT *, max(n_blocks) FILTER (WHERE sg = 0) OVER whole AS all_blocks,
         max(blocked) FILTER (WHERE sg = 0) OVER whole AS all_blocked,
         max(hidden) FILTER (WHERE sg = 0) OVER whole AS all_hidden
  FROM personal WINDOW whole AS (PARTITION BY db, t, tar, o, subject_id)""",
    "cells": """
  SELECT db, t, tar, sg, o, count(*) AS persons, CAST(sum(days) AS BIGINT) AS days,
         count(*) FILTER (WHERE n > 0) AS with_outcome, CAST(sum(n) AS BIGINT) AS events,
         CAST(sum(n_blocks) AS BIGINT) AS n_blocks, CAST(sum(blocked) AS BIGINT) AS blocked,
         count(*) FILTER (WHERE all_blocks > 0 AND span = all_blocked) AS without_time,
         CAST(sum(hidden) AS BIGINT) AS hidden,
         count(*) FILTER (WHERE n > 0 AND all_hidden > 0 AND n = all_hidden) AS lost
  FROM compared_person GROUP BY db, t, tar, sg, o""",
}
KEEP = ("codes", "meas", "cohort", "era", "xcl", "fact", "cells", "summary")


def study(by_site: bool) -> dict[str, str]:
    era = (
        "SELECT database_name AS db, b.* FROM bare_era b JOIN sites USING (subject_id)"
        if by_site
        else "SELECT 'all' AS db, * FROM bare_era"
    )
    dbs = "SELECT DISTINCT database_name AS db FROM sites" if by_site else "SELECT 'all' AS db"
    figures = ("persons", "days", "with_outcome", "events", "blocked", "without_time", "hidden", "lost")
    blank = ", ".join(f"0 AS {f}" for f in figures)
    summed = ", ".join(f"sum({f}) AS {f}" for f in figures)
    return {
        **COHORTS,
        "era": era,
        **MEASURES,
        "dbs": dbs,
        "levels": "SELECT subgroup_id AS sg, name FROM grid UNION ALL SELECT 0, 'All'",
        # The cube and the cells stacked, so that one aggregate brings them together.
        "stacked_cells": f"""
  SELECT db, t, tar_id AS tar, sg, outcome_id AS o, {blank} FROM dbs, target_ref, tar, levels, outcome_ref
  UNION ALL SELECT db, t, tar, sg, o, {", ".join(figures)} FROM cells""",
        "figures": f"SELECT db, t, tar, sg, o, {summed} FROM stacked_cells GROUP BY db, t, tar, sg, o",
        "named_figures": """
  SELECT *, floor(days / 365.25) AS years, floor(days / 365.25) - floor(blocked / 365.25) AS years_left,
         persons - without_time AS persons_left, events - hidden AS events_left
  FROM figures JOIN target_ref USING (t) JOIN tar ON tar_id = tar JOIN levels USING (sg)
  JOIN outcome_ref ON outcome_id = o""",
        "summary": """
  SELECT db AS database_name, CAST(t AS BIGINT) AS target_cohort_definition_id, target_name,
         CAST(tar AS BIGINT) AS time_at_risk_id, CAST(first AS BIGINT) AS time_at_risk_start_offset,
         CAST(0 AS BIGINT) AS time_at_risk_start_index, CAST(last AS BIGINT) AS time_at_risk_end_offset,
         CAST(0 AS BIGINT) AS time_at_risk_end_index, CAST(sg AS BIGINT) AS subgroup_cohort_definition_id,
         name AS subgroup_name, CAST(o AS BIGINT) AS outcome_id,
         CAST(o AS BIGINT) AS outcome_cohort_definition_id, outcome_name,
         CAST(clean_window AS BIGINT) AS clean_window,
         CAST(persons AS BIGINT) AS num_persons_pre_exclude,
         CAST(persons_left AS BIGINT) AS num_persons_at_risk,
         CAST(years AS BIGINT) AS person_years_pre_exclude, CAST(years_left AS BIGINT) AS person_years,
         CAST(with_outcome AS BIGINT) AS num_persons_w_outcome_pre_exclude,
         CAST(with_outcome - lost AS BIGINT) AS num_persons_w_outcome,
         CAST(events AS BIGINT) AS num_outcomes_pre_exclude, CAST(events_left AS BIGINT) AS num_outcomes,
         CASE WHEN persons_left > 0
              THEN 100.0::DOUBLE * CAST(with_outcome - lost AS DOUBLE) / CAST(persons_left AS DOUBLE)
         END AS incidence_proportion_p100p,
         CASE WHEN years_left > 0 THEN 100.0::DOUBLE * CAST(events_left AS DOUBLE) / CAST(years_left AS DOUBLE)
         END AS incidence_rate_p100py
  FROM named_figures""",
    }


DIMENSIONS = (
    "database_name, target_cohort_definition_id, target_name, time_at_risk_id,"
    " time_at_risk_start_offset, time_at_risk_start_index, time_at_risk_end_offset,"
    " time_at_risk_end_index, subgroup_cohort_definition_id, subgroup_name, outcome_id,"
    " outcome_cohort_definition_id, outcome_name, clean_window"
)
RATES = (
    "round(incidence_proportion_p100p, 6) AS incidence_proportion_p100p,"
    " round(incidence_rate_p100py, 6) AS incidence_rate_p100py"
)
COUNTS = [
    "num_persons_w_outcome_pre_exclude",
    "num_persons_w_outcome",
    "num_outcomes_pre_exclude",
    "num_outcomes",
    "num_persons_pre_exclude",
    "num_persons_at_risk",
]


def small(c: str) -> str:
    return f"({c} < 5 AND {c} <> 0)"


CENSORED = ", ".join(f"CASE WHEN {small(c)} THEN CAST(-5 AS BIGINT) ELSE {c} END AS {c}" for c in COUNTS)


def ask(select: str, by_site: bool = False, more: dict[str, str] | None = None) -> str:
    return statement({**study(by_site), **(more or {})}, select, KEEP)


KEYS = (
    "CAST(t AS BIGINT) AS target_cohort_definition_id, CAST(tar AS BIGINT) AS time_at_risk_id"
)
CELL = f"{KEYS}, CAST(sg AS BIGINT) AS subgroup_cohort_definition_id"
OUT = f"{CELL}, CAST(o AS BIGINT) AS outcome_id"


def oracles() -> dict[str, str]:
    years = "CAST(floor(days / 365.25) AS BIGINT) AS person_years"
    # Time at risk is the same for every outcome.
    risk = f"SELECT {CELL}, persons AS num_persons, days AS days_at_risk, {years} FROM cells WHERE o = 201"
    outs = f"SELECT {OUT}, with_outcome AS num_persons_w_outcome, events AS num_outcomes FROM cells WHERE events > 0"
    day_rows = {
        "day_rows": """
  SELECT user_id, event_type, CAST(ts AS DATE) AS s,
         CAST(ts AS DATE) + CAST(length(event_type) % 4 AS INTEGER) AS e FROM events"""
    }
    user_rows = {"user_rows": "SELECT user_id, CAST(ts AS DATE) AS s, CAST(ts AS DATE) AS e FROM events"}
    hidden_rates = " OR ".join(small(c) for c in COUNTS)
    return {
        "tar_windows": ask(f"SELECT {KEYS}, subject_id, s AS start_date, e AS end_date FROM ttar"),
        "interval_union": ask(
            f"SELECT db AS database_name, {KEYS}, subject_id, s AS era_start, e AS era_end FROM era"
        ),
        "event_day_eras": statement(
            day_rows,
            "SELECT user_id, event_type, s AS start_date, e AS end_date FROM ("
            + eras("day_rows", "user_id, event_type")
            + ")",
        ),
        "event_user_eras": statement(
            user_rows,
            "SELECT user_id, s AS start_date, e AS end_date FROM ("
            + eras("user_rows", "user_id", False, 2)
            + ")",
        ),
        "exclusion_periods": ask(
            "SELECT CAST(outcome_id AS BIGINT) AS outcome_id, subject_id, s AS start_date,"
            " e AS end_date FROM exc"
        ),
        "interval_intersect": ask(
            f"SELECT {KEYS}, subject_id, CAST(o AS BIGINT) AS outcome_id, s AS start_date,"
            " e AS end_date FROM xcl"
        ),
        "interval_containment": ask(
            "SELECT CAST(a.t AS BIGINT) AS target_cohort_definition_id,"
            " CAST(a.tar AS BIGINT) AS time_at_risk_id, a.subject_id, a.s AS era_start,"
            " a.e AS era_end, CAST(x.o AS BIGINT) AS outcome_id, x.s AS start_date,"
            " x.e AS end_date FROM era a JOIN xcl x ON a.t = x.t AND a.tar = x.tar"
            " AND a.subject_id = x.subject_id AND a.s <= x.s AND a.e >= x.e"
        ),
        "at_risk_overall": ask(f"{risk} AND sg = 0"),
        "at_risk_subgroup": ask(f"{risk} AND sg <> 0"),
        "outcomes_overall": ask(f"{outs} AND sg = 0"),
        "outcomes_subgroup": ask(f"{outs} AND sg <> 0"),
        "excluded_person_time": ask(
            f"SELECT {OUT}, blocked AS excluded_days,"
            " CAST(floor(blocked / 365.25) AS BIGINT) AS person_years FROM cells WHERE n_blocks > 0"
        ),
        "excluded_persons": ask(
            f"SELECT {OUT}, without_time AS num_persons_w_no_tar FROM cells WHERE without_time > 0"
        ),
        "excluded_outcomes": ask(
            f"SELECT {OUT}, hidden AS num_excluded_outcomes FROM cells WHERE hidden > 0"
        ),
        "persons_losing_outcome": ask(
            f"SELECT {OUT}, lost AS num_persons_excluded_outcomes FROM cells WHERE lost > 0"
        ),
        "remaining_time": ask(
            f"""
SELECT {KEYS}, CAST(o AS BIGINT) AS outcome_id, days, excluded_days,
       days - excluded_days AS days_left
FROM (SELECT t, tar, CAST(SUM(e - s) AS BIGINT) AS days FROM era GROUP BY t, tar)
JOIN (SELECT t, tar, o, CAST(SUM(e - s) AS BIGINT) AS excluded_days FROM xcl GROUP BY t, tar, o)
USING (t, tar)"""
        ),
        "incidence_summary": ask(
            f"SELECT * REPLACE ({RATES}) FROM summary"
        ),
        "incidence_two_analyses": ask(
            f"SELECT * REPLACE ({RATES}) FROM summary WHERE"
            " (target_cohort_definition_id = 101 AND time_at_risk_id IN (6, 7)"
            " AND subgroup_cohort_definition_id IN (0, 41, 42) AND outcome_id IN (201, 203))"
            " OR (target_cohort_definition_id = 102 AND time_at_risk_id = 1"
            " AND subgroup_cohort_definition_id IN (0, 51, 52) AND outcome_id = 202)"
        ),
        "study_twice": ask(
            f"SELECT * REPLACE ({RATES}) FROM summary WHERE target_cohort_definition_id = 102"
            " AND time_at_risk_id = 7 AND outcome_id = 201"
            " AND subgroup_cohort_definition_id IN (0, 41, 42)"
        ),
        "incidence_censored": ask(
            f"SELECT {DIMENSIONS}, {CENSORED}, person_years_pre_exclude, person_years, {RATES}"
            " FROM summary",
            True,
        ),
        "incidence_blanked": ask(
            f"""
SELECT database_name, target_cohort_definition_id, time_at_risk_id, subgroup_cohort_definition_id,
       outcome_id,
       CASE WHEN {small("num_outcomes")} THEN -5 ELSE num_outcomes END AS num_outcomes,
       CASE WHEN NOT ({hidden_rates}) THEN round(incidence_proportion_p100p, 6) END
         AS incidence_proportion_p100p,
       CASE WHEN NOT ({hidden_rates}) THEN round(incidence_rate_p100py, 6) END
         AS incidence_rate_p100py
FROM summary""",
            True,
        ),
        "censored_share": ask(
            " UNION ALL ".join(
                f"SELECT '{c}' AS field, COUNT(*) FILTER (WHERE {small(c)}) AS censored,"
                f" round(CAST(100 AS DOUBLE) * COUNT(*) FILTER (WHERE {small(c)}) / COUNT(*), 1)"
                f" AS percent FROM summary"
                for c in COUNTS
            ),
            True,
        ),
        "run_metadata": statement(
            FIXTURES,
            """
SELECT 'db1' AS database_id, 'Database one' AS database_name, 'All customers' AS description,
       COALESCE((SELECT MAX('v' || r_regionkey) FROM region WHERE r_name = 'None'), 'UNKNOWN')
         AS vocabulary_version,
       MIN(op_start) AS min_obs_period_date, MAX(op_end) AS max_obs_period_date,
       0 AS is_meta_analysis
FROM op""",
        ),
    }
