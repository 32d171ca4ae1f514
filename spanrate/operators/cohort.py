"""From entry events to cohort periods, and statistics on the inclusion rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schemas import COHORT_COLUMNS, literal_frame
from ..sources.clinical import ClinicalTables
from ..sources.durable import durable
from ..specs import CohortSpec, ConceptSet, Criterion, Days, Group, Rule, criteria_of, families
from .criteria import ANCHOR, anchors_of, evaluated, satisfying, shifted
from .events import (
    OWNER,
    CohortBatch,
    criterion_events,
    event_days,
    share_days,
    within_observation,
)
from .intervals import interval_union
from .vocabulary import resolve_concept_sets


def batches(cdm: ClinicalTables, specs: Sequence[CohortSpec]) -> list[tuple[CohortSpec, CohortBatch]]:
    """One batch per family of specs.  All codes are resolved in one pass and kept."""
    groups = families(specs)
    number = {pair: new for family in groups for pair, new in family.codesets}
    sets = [
        (spec.cohort_id, ConceptSet(number[spec.cohort_id, s.codeset_id], s.items))
        for spec in specs
        for s in spec.concept_sets
        if (spec.cohort_id, s.codeset_id) in number
    ]
    codes = resolve_concept_sets(cdm.concept, cdm.concept_ancestor, sets)
    if sets:
        # A written table has a known size: the planner broadcasts it only under its own limit.
        codes = durable(codes)
    return [
        (
            f.merged,
            CohortBatch(
                cdm, f.cohort_ids, codes.where(F.col("cohort_definition_id").isin(*f.cohort_ids))
            ),
        )
        for f in groups
    ]


# Event grain: every qualifying row, for reports on events and rules.


def primary_events(
    batch: CohortBatch,
    criteria: Sequence[Criterion],
    prior_days: int = 0,
    post_days: int = 0,
    limit: str = "All",
) -> DataFrame:
    """Entry events inside an observation period with the required days around them."""
    parts = list(enumerate(criteria))
    events = within_observation(batch, criterion_events(batch, parts), prior_days, post_days)
    return first_per_person(events, "sort_date") if limit == "First" else events


def first_per_person(events: DataFrame, by: str) -> DataFrame:
    """The earliest event per person; ties go to the smallest part, event id and period.

    An aggregate, so no task ever holds all events of one person.
    """
    order = [by, "part", "event_id", "op_start", "op_end"]
    rest = [c for c in events.columns if c not in (*OWNER, *order)]
    return (
        events.groupBy(*OWNER)
        .agg(F.min(F.struct(*order, *rest)).alias("_first"))
        .select(*OWNER, "_first.*")
        .select(*events.columns)
    )


def qualified_events(batch: CohortBatch, spec: CohortSpec) -> DataFrame:
    """Entry events that meet the additional criteria."""
    events = primary_events(
        batch, spec.primary, spec.prior_days, spec.post_days, spec.primary_limit
    )
    if spec.additional is None:
        return events
    anchors = events.select(*OWNER, *ANCHOR).distinct()
    met = satisfying(batch, anchors, spec.additional)
    events = events.join(met, [*OWNER, *ANCHOR], "left_semi")
    return first_per_person(events, "start_date") if spec.qualified_limit == "First" else events


def rule_masks(batch: CohortBatch, anchors: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every index day with one bit per rule it meets, their number and the smallest one."""
    wide, holds = evaluated(batch, anchors, [r.group for r in rules])
    bits = [F.when(h, F.lit(1 << i).cast("long")).otherwise(0) for i, h in enumerate(holds)]
    first = F.coalesce(*[F.when(h, F.lit(i)) for i, h in enumerate(holds)], F.lit(0))
    return wide.select(
        *OWNER,
        *ANCHOR,
        reduce(lambda a, b: a + b, bits).alias("rule_mask"),
        reduce(lambda a, b: a + b, [h.cast("long") for h in holds]).alias("n_rules"),
        first.alias("first_rule"),
    )


def events_with_mask(batch: CohortBatch, spec: CohortSpec) -> DataFrame:
    """Qualified events with their rule mask (0 if no rule is met)."""
    events = qualified_events(batch, spec)
    if not spec.rules:
        return events.withColumns(
            {"rule_mask": F.lit(0).cast("long"), "n_rules": F.lit(0).cast("long"), "first_rule": F.lit(0)}
        )
    anchors = events.select(*OWNER, *ANCHOR).distinct()
    return events.join(rule_masks(batch, anchors, spec.rules), [*OWNER, *ANCHOR])


def _best_first() -> Column:
    """The order in which a person's events count as best."""
    rest = ("first_rule", "start_date", "part", "event_id", "op_start")
    return F.struct((-F.col("n_rules")).alias("_few"), *rest)


def best_event_per_person(events: DataFrame) -> DataFrame:
    """The event with the most rules, then the smallest first rule, then the earliest."""
    return (
        events.groupBy(*OWNER)
        .agg(F.min_by(F.struct(*[c for c in events.columns if c not in OWNER]), _best_first()).alias("_b"))
        .select(*OWNER, "_b.*")
    )


def inclusion_counts(events: DataFrame) -> DataFrame:
    """(mode, cohort, mask, n): events per mask, and persons by the mask of their best event.

    One aggregate of grouping sets; ``mask`` is NULL in the totals.  Events are first counted per
    person and mask, so that what the best event of a person is found among is at most every mask.
    """
    per_mask = events.groupBy(*OWNER, "rule_mask").agg(
        F.count("*").alias("_n"), F.min(_best_first()).alias("_order")
    )
    best = F.min("_order").over(W.partitionBy(*OWNER))
    modes = F.array(
        F.struct(F.lit("event").alias("mode"), F.col("_n").alias("n")),
        F.struct(F.lit("person").alias("mode"), (F.col("_order") == best).cast("long").alias("n")),
    )
    rows = per_mask.select("cohort_definition_id", F.col("rule_mask").alias("mask"), modes.alias("_modes"))
    rows = rows.select("cohort_definition_id", "mask", F.inline("_modes")).where("n > 0")
    whole = ["mode", "cohort_definition_id"]
    return rows.groupingSets([[*whole, "mask"], whole], *whole, "mask").agg(F.sum("n").alias("n"))


def inclusion_tables(events: DataFrame, n_rules: int, cohort_ids: Sequence[int]) -> DataFrame:
    """Results, rules and summaries of all cohorts for both modes, from one pass over the events.

    (mode, table, cohort_definition_id, item, person_count, gain_count, person_total): item is the
    mask of a result row, the rule of a rule row and 0 in a summary, whose person_count meets all
    rules.  A rule's counts are sums over the masks that hold it; cohorts without events have their
    zeros from the same sum.
    """
    full = (1 << n_rules) - 1
    total, n, zero = F.col("mask").isNull(), F.col("n"), F.lit(0).cast("long")

    def row(table: str, item: Column, met: Column, gain: Column, base: Column) -> Column:
        names = ("table", "item", "person_count", "gain_count", "person_total")
        values = (F.lit(table), item.cast("long"), met, gain, base)
        return F.struct(*[v.alias(c) for v, c in zip(values, names, strict=True)])

    def count(when: Column) -> Column:
        return F.when(when, n).otherwise(zero)

    mask = F.coalesce("mask", F.lit(-1).cast("long"))
    of_rules = [
        row(
            "rule",
            F.lit(i),
            count(~total & (mask.bitwiseAND(F.lit(1 << i)) != 0)),
            count(mask == (full ^ 1 << i)),
            count(total),
        )
        for i in range(n_rules)
    ]
    parts = [row("result", mask, count(~total), zero, zero), *of_rules]
    parts.append(row("summary", F.lit(0), count(mask == full), zero, count(total)))
    counted = inclusion_counts(events).select("mode", "cohort_definition_id", F.inline(F.array(*parts)))
    items = [("rule", i) for i in range(n_rules)] + [("summary", 0)]
    empty = [(m, t, c, i, 0, 0, 0) for m in ("event", "person") for c in cohort_ids for t, i in items]
    listed = literal_frame(
        events.sparkSession,
        empty,
        "mode string, table string, cohort_definition_id long, item long,"
        " person_count long, gain_count long, person_total long",
    )
    key = ["mode", "table", "cohort_definition_id", "item"]
    sums = [F.sum(c).alias(c) for c in ("person_count", "gain_count", "person_total")]
    summed = counted.where("table <> 'result' OR item >= 0").unionByName(listed).groupBy(*key).agg(*sums)
    return summed


def inclusion_result(events: DataFrame) -> DataFrame:
    """Events per rule mask."""
    return events.groupBy("cohort_definition_id", F.col("rule_mask").alias("inclusion_rule_mask")).agg(
        F.count("*").alias("person_count")
    )


def _listed(cohort_ids: Sequence[int], counts: DataFrame, n_rules: int | None = None) -> DataFrame:
    """The cohorts (and their rules) with what was counted, zeros where nothing was."""
    rows = [(i, r) for i in cohort_ids for r in range(1 if n_rules is None else n_rules)]
    listed = literal_frame(
        counts.sparkSession, rows, "cohort_definition_id long, rule_sequence int"
    )
    key = ["cohort_definition_id"] + ([] if n_rules is None else ["rule_sequence"])
    listed = listed.select(*key)
    return listed.join(counts, key, "left").fillna(0)


def inclusion_stats(events: DataFrame, n_rules: int, cohort_ids: Sequence[int]) -> DataFrame:
    """Per rule: events that meet it, events that fail only it, and all events."""
    bit = F.expr("shiftleft(1L, rule_sequence)")
    full = (1 << n_rules) - 1
    by_mask = inclusion_result(events)
    rules = F.explode(F.array(*[F.lit(i) for i in range(n_rules)]))
    n = F.col("person_count")
    counts = (
        by_mask.withColumn("rule_sequence", rules)
        .groupBy("cohort_definition_id", "rule_sequence")
        .agg(
            F.sum(F.when(F.col("inclusion_rule_mask").bitwiseAND(bit) != 0, n).otherwise(0)).alias(
                "met"
            ),
            F.sum(F.when(F.col("inclusion_rule_mask") == F.lit(full) - bit, n).otherwise(0)).alias(
                "gain_count"
            ),
            F.sum(n).alias("person_total"),
        )
        .withColumnRenamed("met", "person_count")
    )
    return _listed(cohort_ids, counts, n_rules)


def inclusion_summary(events: DataFrame, n_rules: int, cohort_ids: Sequence[int]) -> DataFrame:
    """All qualified events, and those that meet every rule."""
    counts = events.groupBy("cohort_definition_id").agg(
        F.count("*").alias("base_count"),
        F.count_if(F.col("rule_mask") == (1 << n_rules) - 1).alias("final_count"),
    )
    return _listed(cohort_ids, counts)


# Day grain: what the cohort periods need.


def _entry_anchors(batch: CohortBatch, spec: CohortSpec) -> DataFrame:
    """Index days of the entry events.  A person has at most one per day and period."""
    events = event_days(batch, list(enumerate(spec.primary)))
    if spec.primary_limit == "All":
        return anchors_of(batch, events, OWNER, spec.prior_days, spec.post_days)
    days = events.select(*OWNER, "sort_date", "start_date").distinct()
    inside = within_observation(batch, days, spec.prior_days, spec.post_days)
    return _first_anchor(inside, "sort_date")


def _first_anchor(anchors: DataFrame, by: str) -> DataFrame:
    order = [by, *[c for c in ANCHOR if c != by]]
    return (
        anchors.groupBy(*OWNER)
        .agg(F.min(F.struct(*order)).alias("_first"))
        .select(*OWNER, *[F.col(f"_first.{c}").alias(c) for c in ANCHOR])
    )


def included_anchors(batch: CohortBatch, spec: CohortSpec) -> DataFrame:
    """Index days that pass the additional criteria, every rule and the limits."""
    share_days(batch, list(criteria_of(spec)))
    anchors = _entry_anchors(batch, spec)
    groups = tuple(r.group for r in spec.rules)
    if spec.additional is not None and spec.qualified_limit == "First":
        anchors = _first_anchor(satisfying(batch, anchors, spec.additional), "start_date")
    elif spec.additional is not None:
        groups = (spec.additional, *groups)
    if groups:
        # Everything must hold, so it is one ALL group and one pass.
        anchors = satisfying(batch, anchors, Group("ALL", (), groups))
    if spec.inclusion_limit == "First":
        anchors = _first_anchor(anchors, "start_date")
    return anchors


def cohort_exits(anchors: DataFrame, offset: Days) -> DataFrame:
    """End each index day ``offset`` days later, or with its observation period."""
    ends = anchors.withColumn(
        "end_date", F.least(shifted("start_date", offset), F.col("op_end"))
    )
    return ends.where(F.col("end_date") >= F.col("start_date"))


def collapse(rows: DataFrame, era_pad: int = 0) -> DataFrame:
    """Merge periods of one person that overlap, touch, or lie within the pad."""
    return interval_union(rows, OWNER, "start_date", "end_date", touch=True, pad=era_pad)


def as_cohort(periods: DataFrame) -> DataFrame:
    return periods.select(
        F.col("cohort_definition_id").cast("long").alias("cohort_definition_id"),
        F.col("person_id").alias("subject_id"),
        F.col("start_date").alias("cohort_start_date"),
        F.col("end_date").alias("cohort_end_date"),
    )


def build_cohorts(cdm: ClinicalTables, specs: Sequence[CohortSpec]) -> DataFrame:
    """All cohorts of ``specs`` in one frame, one pass per family."""
    frames = [
        as_cohort(
            collapse(
                cohort_exits(included_anchors(batch, spec), spec.exit_offset), spec.era_pad
            )
        )
        for spec, batch in batches(cdm, specs)
    ]
    return reduce(DataFrame.unionByName, frames)


def cohort_union(*cohorts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.select(*COHORT_COLUMNS) for c in cohorts])


def event_ordinals(
    events: DataFrame, owner: Sequence[str] = OWNER, by: str = "sort_date"
) -> DataFrame:
    """Number the events of each owner 1, 2, ... by date, then event id.

    Rows are numbered within (owner, day) only; the offset of each day is a running sum over
    the owner's days, whose number the calendar bounds.
    """
    cell = [*owner, by]
    sizes = events.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        W.partitionBy(*owner).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    within = F.row_number().over(
        W.partitionBy(*cell).orderBy("event_id", *(["part"] if "part" in events.columns else []))
    )
    return (
        events.withColumn("_within", within)
        .join(offsets, cell)
        .withColumn("ordinal", F.col("_before") + F.col("_within"))
        .drop("_before", "_within")
    )

