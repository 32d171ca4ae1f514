"""Clinical criteria as uniform events.

An event is (person_id, event_id, start_date, end_date, visit_occurrence_id, sort_date).
Several criteria over the same table are read in one scan and told apart by ``part``; several
cohorts likewise by ``cohort_definition_id``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import compare
from ..schemas import EVENT_COLUMNS
from ..sources.clinical import ClinicalTables
from ..sources.durable import durable
from ..specs import Criterion
from .intervals import match_points

OWNER = ["cohort_definition_id", "person_id"]
PERIOD_SLOT_DAYS = 1827


@dataclass(frozen=True)
class CohortBatch:
    """Cohorts built in one pass: their ids, their codes and the tables they read.

    ``codes`` has (cohort_definition_id, codeset_id, concept_id); ``shared`` holds the event
    days of criteria that are used more than once.
    """

    cdm: ClinicalTables
    cohort_ids: tuple[int, ...]
    codes: DataFrame
    shared: dict[Criterion, DataFrame] = field(default_factory=dict, compare=False)


def observation_spans(cdm: ClinicalTables) -> DataFrame:
    return cdm.observation_period.selectExpr(
        "person_id",
        "observation_period_start_date AS op_start",
        "observation_period_end_date AS op_end",
    )


def _conditions(cdm: ClinicalTables, criterion: Criterion) -> DataFrame:
    rows = cdm.condition_occurrence
    if criterion.start is not None:
        rows = rows.where(compare(F.col("condition_start_date"), criterion.start, "date"))
    return rows.selectExpr(
        "person_id",
        "condition_occurrence_id AS event_id",
        "condition_start_date AS start_date",
        "coalesce(condition_end_date, date_add(condition_start_date, 1)) AS end_date",
        "visit_occurrence_id",
        "condition_start_date AS sort_date",
        "condition_concept_id AS concept_id",
    )


def _measurements(cdm: ClinicalTables, criterion: Criterion) -> DataFrame:
    rows = cdm.measurement
    if criterion.start is not None:
        rows = rows.where(compare(F.col("measurement_date"), criterion.start, "date"))
    if criterion.value is not None:
        rows = rows.where(compare(F.col("value_as_number"), criterion.value, "double"))
    if criterion.range_low is not None:
        rows = rows.where(compare(F.col("range_low"), criterion.range_low, "double"))
    if criterion.units:
        rows = rows.where(F.col("unit_concept_id").isin(*criterion.units))
    if criterion.value_concepts:
        rows = rows.where(F.col("value_as_concept_id").isin(*criterion.value_concepts))
    return rows.selectExpr(
        "person_id",
        "measurement_id AS event_id",
        "measurement_date AS start_date",
        "date_add(measurement_date, 1) AS end_date",
        "visit_occurrence_id",
        "measurement_date AS sort_date",
        "measurement_concept_id AS concept_id",
    )


def _visits(cdm: ClinicalTables, criterion: Criterion) -> DataFrame:
    rows = cdm.visit_occurrence
    if criterion.start is not None:
        rows = rows.where(compare(F.col("visit_start_date"), criterion.start, "date"))
    return rows.selectExpr(
        "person_id",
        "visit_occurrence_id AS event_id",
        "visit_start_date AS start_date",
        "visit_end_date AS end_date",
        "visit_occurrence_id",
        "visit_start_date AS sort_date",
        "visit_concept_id AS concept_id",
    )


def _periods(cdm: ClinicalTables, criterion: Criterion) -> DataFrame:
    rows = cdm.observation_period
    start, end = "observation_period_start_date", "observation_period_end_date"
    if criterion.start is not None:
        rows = rows.where(compare(F.col(start), criterion.start, "date"))
    if criterion.on_dates is not None:
        start, end = (f"DATE '{d}'" for d in criterion.on_dates)
        for day in (start, end):
            rows = rows.where(
                f"{day} BETWEEN observation_period_start_date AND observation_period_end_date"
            )
    return rows.selectExpr(
        "person_id",
        "observation_period_id AS event_id",
        f"{start} AS start_date",
        f"{end} AS end_date",
        "CAST(NULL AS BIGINT) AS visit_occurrence_id",
        "observation_period_start_date AS sort_date",
    )


_SCANS = {
    "condition": _conditions,
    "measurement": _measurements,
    "visit": _visits,
    "observation_period": _periods,
}


SALTS = 16
#: More codes than this are never collected: a code takes some 100 bytes in every process.
BROADCAST_CODES = 100_000


def with_codes(scan: DataFrame, codes: DataFrame) -> DataFrame:
    """Events of the listed codes.

    Few codes, by their number and not by the size of a file, are sent to the events as they are.
    Many are shuffled with the events, whatever the planner takes their size for: there they are
    repeated per salt and the events carry one by person, so a code that most events have is
    spread over many tasks.
    """
    if codes.count() <= BROADCAST_CODES:
        return scan.join(F.broadcast(codes), "concept_id")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = scan.withColumn("_salt", F.pmod(F.xxhash64("person_id"), F.lit(SALTS)).cast("int"))
    return salted.join(codes.withColumn("_salt", salts).hint("merge"), ["concept_id", "_salt"]).drop("_salt")


def criterion_events(batch: CohortBatch, parts: Sequence[tuple[int, Criterion]]) -> DataFrame:
    """Events of all ``parts``: cohort_definition_id, part and the event columns.

    Criteria that differ by their code set only share one scan.
    """
    from .criteria import anchors_of, satisfying  # nested criteria are groups themselves

    shared: dict[Criterion, list[tuple[int, int | None]]] = {}
    for part, criterion in parts:
        shared.setdefault(replace(criterion, codeset_id=None), []).append(
            (part, criterion.codeset_id)
        )
    columns = ["cohort_definition_id", "part", *EVENT_COLUMNS]
    frames = []
    for criterion, uses in shared.items():
        scan = _SCANS[criterion.domain](batch.cdm, criterion)
        coded = {}
        for part, codeset in uses:
            if codeset is not None:
                coded.setdefault(codeset, []).append(part)
        if coded:
            pairs = [f"{c}, array({', '.join(map(str, ps))})" for c, ps in coded.items()]
            to_parts = f"map({', '.join(pairs)})"
            codes = batch.codes.where(f"codeset_id IN ({', '.join(map(str, coded))})").selectExpr(
                "cohort_definition_id",
                "concept_id",
                f"explode(element_at({to_parts}, codeset_id)) AS part",
            )
            frames.append((criterion, with_codes(scan, codes).selectExpr(*columns)))
        free = [part for part, codeset in uses if codeset is None]
        if free:
            ids = ", ".join(f"{i}L" for i in batch.cohort_ids)
            numbers = ", ".join(map(str, free))
            tagged = scan.selectExpr("*", f"explode(array({ids})) AS cohort_definition_id")
            tagged = tagged.selectExpr("*", f"explode(array({numbers})) AS part")
            frames.append((criterion, tagged.selectExpr(*columns)))
    events = None
    for criterion, frame in frames:
        if criterion.nested is not None:
            owner = ["cohort_definition_id", "part", "person_id"]
            frame = durable(frame)
            anchors = anchors_of(batch, frame, owner)
            kept = satisfying(batch, anchors, criterion.nested, owner)
            days = kept.select(*owner, "start_date").distinct()
            frame = frame.join(days, [*owner, "start_date"], "left_semi").select(*columns)
        events = frame if events is None else events.unionByName(frame)
    return events


NO_CODES = -1


def _event_days(batch: CohortBatch, criterion: Criterion, codesets: Sequence[int]) -> DataFrame:
    """(cohort, codeset, person, start, end, sort_date, n): events of equal days as one row.

    The first thing that happens to the events is this aggregate, keyed by day, so neither a
    person nor a code with very many events reaches a single task.
    """
    from .criteria import anchors_of, satisfying

    scan = _SCANS[criterion.domain](batch.cdm, criterion)
    frames = []
    coded = [c for c in codesets if c != NO_CODES]
    if coded:
        codes = batch.codes.where(f"codeset_id IN ({', '.join(map(str, coded))})")
        frames.append(with_codes(scan, codes))
    if NO_CODES in codesets:
        ids = ", ".join(f"{i}L" for i in batch.cohort_ids)
        frames.append(
            scan.selectExpr(
                "*", f"{NO_CODES} AS codeset_id", f"explode(array({ids})) AS cohort_definition_id"
            )
        )
    owner = ["cohort_definition_id", "codeset_id", "person_id"]
    key = [*owner, "start_date", "end_date", "sort_date"]
    days = reduce(DataFrame.unionByName, [f.selectExpr(*key) for f in frames])
    days = days.groupBy(*key).agg(F.count("*").alias("n"))
    if criterion.nested is None:
        return days
    days = durable(days)
    kept = satisfying(batch, anchors_of(batch, days, owner), criterion.nested, owner)
    kept = kept.select(*owner, "start_date").distinct()
    return days.join(kept, [*owner, "start_date"], "left_semi")


def share_days(batch: CohortBatch, uses: Sequence[Criterion]) -> None:
    """Keep the event days of criteria that differ at most by codes and occur repeatedly.

    A clean window, for one, looks for the very events that enter the cohort: the table is
    then scanned once for both.
    """
    codesets: dict[Criterion, list[int]] = {}
    for criterion in uses:
        number = NO_CODES if criterion.codeset_id is None else criterion.codeset_id
        codesets.setdefault(replace(criterion, codeset_id=None), []).append(number)
    # Nested criteria are listed after the one they belong to, and are needed first.
    for criterion, numbers in reversed(codesets.items()):
        if len(numbers) > 1 and criterion.domain != "observation_period":
            distinct = sorted(set(numbers))
            batch.shared[criterion] = durable(_event_days(batch, criterion, distinct))


def event_days(batch: CohortBatch, parts: Sequence[tuple[int, Criterion]]) -> DataFrame:
    """Events of all ``parts`` with equal days as one row: (owner, part, days, n)."""
    groups: dict[Criterion, dict[int, list[int]]] = {}
    for part, criterion in parts:
        number = NO_CODES if criterion.codeset_id is None else criterion.codeset_id
        uses = groups.setdefault(replace(criterion, codeset_id=None), {})
        uses.setdefault(number, []).append(part)
    columns = [*OWNER, "start_date", "end_date", "sort_date", "n"]
    frames = []
    for criterion, uses in groups.items():
        days = batch.shared.get(criterion)
        if days is None:
            days = _event_days(batch, criterion, list(uses))
        pairs = ", ".join(f"{c}, array({', '.join(map(str, ps))})" for c, ps in uses.items())
        frames.append(
            days.where(f"codeset_id IN ({', '.join(map(str, uses))})").selectExpr(
                *columns, f"explode(element_at(map({pairs}), codeset_id)) AS part"
            )
        )
    return reduce(DataFrame.unionByName, frames)


def within_observation(
    batch: CohortBatch, events: DataFrame, prior_days: int = 0, post_days: int = 0
) -> DataFrame:
    """Events joined to the observation period that covers them, with the required days inside.

    The required days narrow the period before the join, so one range test does both.
    """
    spans = observation_spans(batch.cdm).selectExpr(
        "*",
        f"date_add(op_start, {prior_days}) AS _from",
        f"date_sub(op_end, {post_days}) AS _to",
    )
    return match_points(
        events, spans, ["person_id"], "start_date", "_from", "_to", PERIOD_SLOT_DAYS
    ).drop("_from", "_to")
