"""Person-time at risk, outcomes and exclusions, summed to an incidence cube.

Grains, from fine to coarse:

* era: one merged at-risk period of a person for a target and time at risk;
* era and outcome: what happened in that era;
* person, subgroup and outcome;
* cell: database, target, time at risk, subgroup, outcome.

Every step to a coarser grain is an ordinary aggregate with a map-side part.

Frames of days are laid out by person (``by_person``) before they meet.  What a person holds of the
smaller side travels as one array, so that the person is the whole key of every join: joins, windows
and sums of persons then need no shuffle of their own, up to the sums of the cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between, plus_days
from ..schemas import IR_SUMMARY_DDL, REFERENCE_DDL, conform, fan_out, literal_frame
from ..sources.durable import durable
from ..specs import Analysis, OutcomeSpec, SubgroupSpec, TargetSpec, TarSpec
from .intervals import interval_union

DAYS_PER_YEAR = 365.25
DESIGN = ["target_cohort_definition_id", "time_at_risk_id"]
ERA = ["database_name", *DESIGN, "subject_id", "era_start", "era_end"]
PERSON = ["database_name", *DESIGN, "subject_id"]
STRATUM = ["database_name", *DESIGN, "subgroup_cohort_definition_id"]
CELL = [*STRATUM, "outcome_id"]
SUBGROUPS = "subgroups"


@dataclass(frozen=True)
class Settings:
    targets: Sequence[TargetSpec]
    tars: Sequence[TarSpec]
    subgroups: Sequence[SubgroupSpec]
    outcomes: Sequence[OutcomeSpec]

    def chosen_by(self, analysis: Analysis) -> Settings:
        return Settings(
            [t for t in self.targets if t.target_cohort_definition_id in analysis.target_ids],
            [t for t in self.tars if t.time_at_risk_id in analysis.time_at_risk_ids],
            [
                s
                for s in self.subgroups
                if s.subgroup_cohort_definition_id in analysis.subgroup_ids
            ],
            [o for o in self.outcomes if o.outcome_id in analysis.outcome_ids],
        )


#: Analyses that one build can serve: the bits of a long, without its sign.
SHARED_ANALYSES = 63


class Membership:
    """Which of several analyses a row serves, as bits of a long.

    An analysis is a product of target, window, subgroup and outcome lists, so the bits of a row are
    the common bits of its ids, looked up in literals.  Subgroup 0, everybody, serves all.
    """

    def __init__(self, analyses: Sequence[Analysis]):
        if not 0 < len(analyses) <= SHARED_ANALYSES:
            raise ValueError(f"one build serves 1 to {SHARED_ANALYSES} analyses, not {len(analyses)}")
        self.n = len(analyses)
        lists = {
            "target_cohort_definition_id": [a.target_ids for a in analyses],
            "time_at_risk_id": [a.time_at_risk_ids for a in analyses],
            "subgroup_cohort_definition_id": [(0, *a.subgroup_ids) for a in analyses],
            "outcome_id": [a.outcome_ids for a in analyses],
        }
        self.bits: dict[str, dict[int, int]] = {}
        for column, of_each in lists.items():
            found = self.bits.setdefault(column, {})
            for at, ids in enumerate(of_each):
                for i in set(ids):
                    found[i] = found.get(i, 0) | 1 << at

    def of(self, *columns: str) -> Column:
        common = F.lit((1 << self.n) - 1).cast("long")
        for column in columns:
            pairs = [F.lit(x).cast("long") for pair in sorted(self.bits[column].items()) for x in pair]
            own = F.try_element_at(F.create_map(*pairs), F.col(column).cast("long"))
            common = common.bitwiseAND(F.coalesce(own, F.lit(0).cast("long")))
        return common

    def used(self, df: DataFrame, *columns: str) -> DataFrame:
        """Rows that some analysis needs."""
        return df.where(self.of(*columns) != 0)

    def dealt(self, cells: DataFrame) -> DataFrame:
        """Every cell once per analysis that reports it."""
        served = F.filter(
            F.sequence(F.lit(0), F.lit(self.n - 1)),
            lambda i: F.getbit(self.of(*self.bits), i) == 1,
        )
        return cells.withColumn("_analysis", F.explode(served)).drop("_analysis")


# Settings as rows.  They are driver-side lists, so their size is known.


def tar_rows(tars: Sequence[TarSpec]) -> list[tuple]:
    return [
        (t.time_at_risk_id, t.start_offset, t.start_index, t.end_offset, t.end_index) for t in tars
    ]


def target_frame(spark, targets: Sequence[TargetSpec]) -> DataFrame:
    rows = [(t.target_cohort_definition_id, t.target_name) for t in targets]
    return literal_frame(spark, rows, REFERENCE_DDL["target_ref"])


def tar_frame(spark, tars: Sequence[TarSpec]) -> DataFrame:
    return literal_frame(spark, tar_rows(tars), REFERENCE_DDL["time_at_risk"])


def subgroup_frame(spark, subgroups: Sequence[SubgroupSpec]) -> DataFrame:
    rows = [(s.subgroup_cohort_definition_id, s.subgroup_name) for s in subgroups]
    return literal_frame(spark, rows, REFERENCE_DDL["subgroup_ref"])


def outcome_frame(spark, outcomes: Sequence[OutcomeSpec]) -> DataFrame:
    rows = [
        (
            o.outcome_id,
            o.outcome_cohort_definition_id,
            o.outcome_name,
            o.clean_window,
            o.primary_time_at_risk_start_offset,
            o.primary_time_at_risk_start_index,
            o.primary_time_at_risk_end_offset,
            o.primary_time_at_risk_end_index,
            o.excluded_cohort_definition_id,
        )
        for o in outcomes
    ]
    return literal_frame(spark, rows, REFERENCE_DDL["outcome_ref"])


def reference_cube(databases: DataFrame, settings: Settings) -> DataFrame:
    """Every database x target x time at risk x subgroup (and 'All', id 0) x outcome."""
    strata = dict.fromkeys([SubgroupSpec(0, "All"), *settings.subgroups])
    lists = [
        ([(t.target_cohort_definition_id, t.target_name) for t in settings.targets], "target_ref"),
        (tar_rows(settings.tars), "time_at_risk"),
        ([(s.subgroup_cohort_definition_id, s.subgroup_name) for s in strata], "subgroup_ref"),
    ]
    cube = databases
    for rows, name in lists:
        cube = fan_out(cube, rows, REFERENCE_DDL[name])
    outcomes = [
        (o.outcome_id, o.outcome_cohort_definition_id, o.outcome_name, o.clean_window)
        for o in settings.outcomes
    ]
    return fan_out(
        cube,
        outcomes,
        "outcome_id long, outcome_cohort_definition_id long, outcome_name string, clean_window int",
    )


# Person level.


def by_person(df: DataFrame) -> DataFrame:
    """Rows of a person in one place.  Equal days are one row before, so the calendar bounds them."""
    return df.repartition("subject_id")


def time_at_risk(
    targets: DataFrame, observation_period: DataFrame, tars: Sequence[TarSpec]
) -> DataFrame:
    """Target periods turned into at-risk windows, cut at the end of observation."""
    spans = observation_period.select(
        F.col("person_id").alias("subject_id"),
        F.col("observation_period_start_date").alias("op_start"),
        F.col("observation_period_end_date").alias("op_end"),
    )
    observed = by_person(targets.distinct()).join(by_person(spans).hint("merge"), "subject_id")
    observed = observed.where(F.col("cohort_start_date").between(F.col("op_start"), F.col("op_end")))

    def edge(side: str) -> Column:
        anchor = F.when(
            F.col(f"time_at_risk_{side}_index") == 0, F.col("cohort_start_date")
        ).otherwise(F.col("cohort_end_date"))
        return F.least(plus_days(anchor, F.col(f"time_at_risk_{side}_offset")), F.col("op_end"))

    return fan_out(observed, tar_rows(tars), REFERENCE_DDL["time_at_risk"]).select(
        F.col("cohort_definition_id").alias("target_cohort_definition_id"),
        "time_at_risk_id",
        "subject_id",
        edge("start").alias("start_date"),
        edge("end").alias("end_date"),
    )


def at_risk_eras(windows: DataFrame, sites: DataFrame | None, database_name: str) -> DataFrame:
    """Merged at-risk windows per person, with the database the person belongs to.

    A person with windows must have exactly one site; anything else stops the run.
    """
    eras = interval_union(windows, [*DESIGN, "subject_id"])
    eras = eras.withColumnsRenamed({"start_date": "era_start", "end_date": "era_end"})
    if sites is None:
        return eras.withColumn("database_name", F.lit(database_name)).select(*ERA)
    placed = sites.groupBy("subject_id").agg(
        F.count("*").alias("_n"), F.min("database_name").alias("database_name")
    )
    site = F.when(F.col("_n") == 1, F.col("database_name"))
    wrong = F.concat(F.lit("not exactly one site for person "), F.col("subject_id").cast("string"))
    one = F.coalesce(site, F.raise_error(wrong).cast("string"))
    return eras.join(placed, "subject_id", "left").withColumn("database_name", one).select(*ERA)


def persons_at_risk(eras: DataFrame, subgroups: DataFrame) -> DataFrame:
    """A row per person: the eras, each with the subgroups it counts for.

    These are 'All' (0) and one per subgroup period that holds the start of the era.
    """
    period = F.struct(
        F.col("cohort_definition_id").cast("long").alias("id"),
        F.col("cohort_start_date").alias("from"),
        F.col("cohort_end_date").alias("to"),
    )
    lasting = F.col("cohort_start_date") <= F.col("cohort_end_date")
    spans = by_person(subgroups.where(lasting)).groupBy("subject_id")
    spans = spans.agg(F.collect_list(period).alias("_spans"))
    fields = [*DESIGN, "era_start", "era_end"]
    persons = by_person(eras).groupBy("database_name", "subject_id")
    persons = persons.agg(F.collect_list(F.struct(*fields)).alias("eras"))

    def tagged(era: Column) -> Column:
        holding = F.filter("_spans", lambda p: era["era_start"].between(p["from"], p["to"]))
        own = F.coalesce(F.transform(holding, lambda p: p["id"]), F.array().cast("array<long>"))
        found = F.concat(F.array(F.lit(0).cast("long")), own)
        return F.struct(*[era[c].alias(c) for c in fields], found.alias(SUBGROUPS))

    return persons.join(spans.hint("merge"), "subject_id", "left").select(
        "database_name", "subject_id", F.transform("eras", tagged).alias("eras")
    )


def eras_of(persons: DataFrame) -> DataFrame:
    return persons.select("*", F.inline("eras")).select(*ERA, SUBGROUPS)


def per_subgroup(df: DataFrame) -> DataFrame:
    """Every row once per subgroup it counts for."""
    rest = [c for c in df.columns if c != SUBGROUPS]
    return df.select(*rest, F.explode(SUBGROUPS).alias("subgroup_cohort_definition_id"))


def meet_eras(rows: DataFrame, persons: DataFrame, when) -> DataFrame:
    """Rows of a person, once per era for which ``when`` holds; the era's columns begin with it."""
    eras = by_person(persons).select("subject_id", F.col("database_name").alias("_site"), "eras")
    own = [c for c in rows.columns if c not in (*ERA, SUBGROUPS)]
    met = by_person(rows).join(eras.hint("merge"), "subject_id")
    met = met.select("subject_id", F.col("_site").alias("database_name"), *own, F.inline(F.filter("eras", when)))
    return met.select(*ERA, SUBGROUPS, *own)


def excluded_periods(cohorts: DataFrame, outcomes: Sequence[OutcomeSpec]) -> DataFrame:
    """Time a person cannot count for an outcome: clean windows and exclusion cohorts.

    The clean window runs from the day after an outcome *start*, whatever its end.
    """
    ref = F.broadcast(outcome_frame(cohorts.sparkSession, outcomes))
    start = F.col("cohort_start_date")
    clean = (
        cohorts.join(
            ref.where(F.col("clean_window") >= 1),
            F.col("cohort_definition_id") == F.col("outcome_cohort_definition_id"),
        )
        .select(
            "outcome_id",
            "subject_id",
            plus_days(start, 1).alias("start_date"),
            plus_days(start, F.col("clean_window")).alias("end_date"),
        )
    )
    named = cohorts.join(
        ref, F.col("cohort_definition_id") == F.col("excluded_cohort_definition_id")
    ).select(
        "outcome_id",
        "subject_id",
        start.alias("start_date"),
        F.col("cohort_end_date").alias("end_date"),
    )
    return clean.unionByName(named)


def excluded_at_risk(
    excluded: DataFrame, persons: DataFrame, membership: Membership | None = None
) -> DataFrame:
    """Excluded periods cut to the at-risk eras and merged per person and outcome."""
    start, end = F.col("start_date"), F.col("end_date")
    cut = meet_eras(
        excluded.where(start <= end).distinct(),
        persons,
        lambda e: (e["era_start"] <= e["era_end"]) & (start <= e["era_end"]) & (end >= e["era_start"]),
    )
    cut = membership.used(cut, *DESIGN, "outcome_id") if membership else cut
    cut = cut.withColumns({"start_date": F.greatest(start, "era_start"), "end_date": F.least(end, "era_end")})
    return interval_union(cut, [*PERSON, "outcome_id"])


def outcome_days(cohorts: DataFrame, outcome_ids: Sequence[int]) -> DataFrame:
    """Outcome starts per person and day, with their number."""
    return (
        cohorts.where(F.col("cohort_definition_id").isin(*outcome_ids))
        .groupBy(
            F.col("cohort_definition_id").cast("long").alias("outcome_id"),
            "subject_id",
            F.col("cohort_start_date").alias("outcome_date"),
        )
        .agg(F.count("*").alias("n"))
    )


def era_outcomes(persons: DataFrame, days: DataFrame) -> DataFrame:
    """(era, outcome, n_outcomes): outcome starts inside each era, both ends included."""
    day = F.col("outcome_date")
    hits = meet_eras(days, persons, lambda e: day.between(e["era_start"], e["era_end"]))
    return hits.select(*ERA, SUBGROUPS, "outcome_id", F.col("n").alias("n_outcomes"))


def era_exclusions(persons: DataFrame, excluded: DataFrame) -> DataFrame:
    """Excluded periods with the at-risk era that contains them."""
    start, end = F.col("start_date"), F.col("end_date")
    target, window = (f"_{c}" for c in DESIGN)
    inside = meet_eras(
        excluded.withColumnsRenamed({c: f"_{c}" for c in DESIGN}),
        persons,
        lambda e: (e[DESIGN[1]] == F.col(window))
        & (e[DESIGN[0]] == F.col(target))
        & start.between(e["era_start"], e["era_end"])
        & (end <= e["era_end"]),
    )
    return inside.drop(target, window)


def excluded_with_outcomes(excluded: DataFrame, days: DataFrame) -> DataFrame:
    """Excluded periods with the number of outcome starts inside, ``n_excluded``."""
    day = F.struct("outcome_id", "outcome_date", "n")
    listed = by_person(days).groupBy("subject_id").agg(F.collect_list(day).alias("_days"))
    inside = F.filter(
        "_days",
        lambda d: (d["outcome_id"] == F.col("outcome_id"))
        & d["outcome_date"].between(F.col("start_date"), F.col("end_date")),
    )
    number = F.aggregate(inside, F.lit(0).cast("long"), lambda total, d: total + d["n"])
    met = by_person(excluded).join(listed.hint("merge"), "subject_id", "left")
    return met.select(*excluded.columns, F.coalesce(number, F.lit(0).cast("long")).alias("n_excluded"))


def person_time(persons: DataFrame) -> DataFrame:
    """(person, subgroup): at-risk days with both ends counted, and day differences."""
    days = days_between("era_start", "era_end")
    rows = per_subgroup(eras_of(by_person(persons)))
    return rows.groupBy(*PERSON, "subgroup_cohort_definition_id").agg(
        F.sum(days + 1).alias("days_at_risk"), F.sum(days).alias("day_span")
    )


_MEASURES = ["n_outcomes", "excluded_days", "n_exclusions", "n_excluded"]


def person_outcomes(outcomes: DataFrame, within: DataFrame) -> DataFrame:
    """(person, subgroup, outcome): what happened in the eras of the subgroup, and their exclusions."""
    days = days_between("start_date", "end_date")
    spent = within.withColumns({"excluded_days": days, "n_exclusions": F.lit(1).cast("long")})
    key = [*PERSON, SUBGROUPS, "outcome_id"]
    sums = [F.sum(m).alias(m) for m in _MEASURES]
    zero = F.lit(0).cast("long")

    def measures(df: DataFrame) -> DataFrame:
        rows = df.select(*key, *[F.col(m) if m in df.columns else zero.alias(m) for m in _MEASURES])
        return rows.groupBy(*key).agg(*sums)

    rows = per_subgroup(by_person(measures(outcomes).unionByName(measures(spent))))
    return rows.groupBy(*PERSON, "subgroup_cohort_definition_id", "outcome_id").agg(*sums)


# Cell level.


def at_risk_cells(per_person: DataFrame) -> DataFrame:
    return per_person.groupBy(*STRATUM).agg(
        F.count("*").alias("num_persons"), F.sum("days_at_risk").alias("days_at_risk")
    )


def measure_cells(per_person: DataFrame, per_outcome: DataFrame) -> DataFrame:
    """Every measure of a cell by one aggregate.

    A person's excluded time and outcomes count against the whole person (subgroup 0), in every
    subgroup the person has time in.
    """
    subgroup = F.col("subgroup_cohort_definition_id")
    stratum = F.struct(*DESIGN, subgroup, "day_span")
    strata = by_person(per_person).groupBy("subject_id").agg(F.collect_list(stratum).alias("_strata"))

    def whole(measure: str) -> Column:
        return F.max(F.when(subgroup == 0, F.col(measure)))

    measured = by_person(per_outcome).groupBy(*PERSON, "outcome_id").agg(
        whole("excluded_days").alias("_all_days"),
        whole("n_exclusions").alias("_all_exclusions"),
        whole("n_excluded").alias("_all_excluded"),
        F.collect_list(F.struct(subgroup, *_MEASURES)).alias("_parts"),
    )

    def with_part(s: Column) -> Column:
        name = "subgroup_cohort_definition_id"
        part = F.get(F.filter("_parts", lambda p: p[name] == s[name]), F.lit(0))
        return F.struct(s[name].alias(name), s["day_span"].alias("day_span"), part.alias("_part"))

    own = F.filter(
        "_strata",
        lambda s: (s[DESIGN[1]] == F.col(DESIGN[1])) & (s[DESIGN[0]] == F.col(DESIGN[0])),
    )
    rows = measured.where(F.col("_all_exclusions").isNotNull()).join(strata.hint("merge"), "subject_id")
    rows = rows.select("*", F.inline(F.transform(own, with_part))).select("*", *[F.col(f"_part.{m}").alias(m) for m in _MEASURES])
    had = F.col("n_outcomes") > 0
    no_time = (F.col("_all_exclusions") > 0) & (F.col("day_span") == F.col("_all_days"))
    lost = had & (F.col("_all_excluded") > 0) & (F.col("n_outcomes") == F.col("_all_excluded"))
    return rows.groupBy(*CELL).agg(
        F.count_if(had).alias("num_persons_w_outcome"),
        F.sum("n_outcomes").alias("num_outcomes"),
        F.sum("excluded_days").alias("excluded_days"),
        F.sum("n_exclusions").alias("num_exclusions"),
        F.count_if(no_time).alias("num_persons_w_no_tar"),
        F.sum("n_excluded").alias("num_excluded_outcomes"),
        F.count_if(lost).alias("num_persons_excluded_outcomes"),
    )


def outcome_cells(cells: DataFrame) -> DataFrame:
    counts = ["num_persons_w_outcome", "num_outcomes"]
    return cells.where(F.col("num_outcomes") > 0).select(*CELL, *counts)


def excluded_time_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("num_exclusions") > 0).select(*CELL, "excluded_days")


def excluded_person_cells(cells: DataFrame) -> DataFrame:
    """Persons whose time in the subgroup equals all their excluded time for the outcome."""
    return cells.where(F.col("num_persons_w_no_tar") > 0).select(*CELL, "num_persons_w_no_tar")


def excluded_outcome_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("num_excluded_outcomes") > 0).select(*CELL, "num_excluded_outcomes")


def lost_outcome_cells(cells: DataFrame) -> DataFrame:
    """Persons whose outcomes in the subgroup equal all their excluded outcomes."""
    name = "num_persons_excluded_outcomes"
    return cells.where(F.col(name) > 0).select(*CELL, name)


def person_years(days: Column, exact: bool = False) -> Column:
    """Whole years, as the summary table stores them, or the exact quotient."""
    years = days.cast("double") / DAYS_PER_YEAR
    return years if exact else F.floor(years).cast("long")


def per_hundred(numerator: Column, denominator: Column) -> Column:
    return F.when(
        denominator > 0, F.lit(100.0) * numerator.cast("double") / denominator.cast("double")
    )


def summary(
    cube: DataFrame, at_risk: DataFrame, cells: DataFrame, exact_years: bool = False
) -> DataFrame:
    """The reference cube with every measure, zeros where nothing was found.

    Whole years lose small strata; ``exact_years`` makes both year columns doubles.
    """
    out = cube.join(at_risk, STRATUM, "left").join(cells, CELL, "left")

    def some(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    out = (
        out.withColumn("num_persons_pre_exclude", some("num_persons"))
        .withColumn("num_persons_at_risk", some("num_persons") - some("num_persons_w_no_tar"))
        .withColumn("person_years_pre_exclude", person_years(some("days_at_risk"), exact_years))
        .withColumn(
            "person_years",
            F.col("person_years_pre_exclude") - person_years(some("excluded_days"), exact_years),
        )
        .withColumn("num_persons_w_outcome_pre_exclude", some("num_persons_w_outcome"))
        .withColumn(
            "num_persons_w_outcome",
            F.col("num_persons_w_outcome_pre_exclude") - some("num_persons_excluded_outcomes"),
        )
        .withColumn("num_outcomes_pre_exclude", some("num_outcomes"))
        .withColumn(
            "num_outcomes", F.col("num_outcomes_pre_exclude") - some("num_excluded_outcomes")
        )
        .withColumn(
            "incidence_proportion_p100p",
            per_hundred(F.col("num_persons_w_outcome"), F.col("num_persons_at_risk")),
        )
        .withColumn(
            "incidence_rate_p100py", per_hundred(F.col("num_outcomes"), F.col("person_years"))
        )
    )
    if not exact_years:
        return conform(out, IR_SUMMARY_DDL)
    ddl = IR_SUMMARY_DDL
    for name in ("person_years_pre_exclude", "person_years"):
        ddl = ddl.replace(f"{name} long", f"{name} double")
    return conform(out, ddl)


# The analysis.


class Study:
    """The person-level frames of one analysis, each composed when first asked for.

    ``sites`` (subject_id, database_name) runs the analysis of all databases at once.
    ``analyses`` builds several at once: ``settings`` is then what they choose from, every frame
    holds what any of them needs, and the summary has each analysis' cells.
    ``keep`` writes the persons' eras, which several measures read, to the shared folder.
    """

    def __init__(
        self,
        observation_period: DataFrame,
        targets: DataFrame,
        outcomes: DataFrame,
        subgroups: DataFrame,
        settings: Settings,
        database_name: str = "",
        sites: DataFrame | None = None,
        keep: bool = True,
        analyses: Sequence[Analysis] | None = None,
    ):
        self.observation_period = observation_period
        self.targets = targets
        self.outcomes = outcomes
        self.subgroups = subgroups
        self.settings = settings
        self.database_name = database_name
        self.sites = sites
        self.membership = Membership(analyses) if analyses else None
        self._hold = durable if keep else (lambda df: df)

    def _used(self, df: DataFrame, *columns: str) -> DataFrame:
        return self.membership.used(df, *columns) if self.membership else df

    @cached_property
    def windows(self) -> DataFrame:
        ids = [t.target_cohort_definition_id for t in self.settings.targets]
        chosen = self.targets.where(F.col("cohort_definition_id").isin(*ids))
        windows = time_at_risk(chosen, self.observation_period, self.settings.tars)
        return self._used(windows, *DESIGN)

    @cached_property
    def persons(self) -> DataFrame:
        """A row per person with the eras and their subgroups."""
        ids = [s.subgroup_cohort_definition_id for s in self.settings.subgroups]
        chosen = self.subgroups.where(F.col("cohort_definition_id").isin(*ids))
        eras = at_risk_eras(self.windows, self.sites, self.database_name)
        return self._hold(persons_at_risk(eras, chosen))

    @cached_property
    def eras(self) -> DataFrame:
        return eras_of(self.persons).drop(SUBGROUPS)

    @cached_property
    def days(self) -> DataFrame:
        return outcome_days(self.outcomes, [o.outcome_id for o in self.settings.outcomes])

    @cached_property
    def excluded(self) -> DataFrame:
        periods = excluded_periods(self.outcomes, self.settings.outcomes)
        return excluded_at_risk(periods, self.persons, self.membership)

    @cached_property
    def within(self) -> DataFrame:
        return era_exclusions(self.persons, self.excluded).drop(SUBGROUPS)

    @cached_property
    def per_person(self) -> DataFrame:
        return self._used(person_time(self.persons), *DESIGN, "subgroup_cohort_definition_id")

    @cached_property
    def per_outcome(self) -> DataFrame:
        outcomes = self._used(era_outcomes(self.persons, self.days), *DESIGN, "outcome_id")
        within = era_exclusions(self.persons, excluded_with_outcomes(self.excluded, self.days))
        return self._used(person_outcomes(outcomes, within), *CELL[1:])

    @cached_property
    def cells(self) -> DataFrame:
        return measure_cells(self.per_person, self.per_outcome)

    def cube(self) -> DataFrame:
        if self.sites is None:
            one = self.targets.sparkSession.range(1)
            databases = one.select(F.lit(self.database_name).alias("database_name"))
        else:
            databases = self.sites.select("database_name").distinct()
        return self._used(reference_cube(databases, self.settings), *CELL[1:])

    def summary(self, exact_years: bool = False) -> DataFrame:
        at_risk = at_risk_cells(self.per_person)
        cells = summary(self.cube(), at_risk, self.cells, exact_years)
        return self.membership.dealt(cells) if self.membership else cells


def incidence(*args, **kwargs) -> DataFrame:
    """The incidence summary, one row per cell of the reference cube of each analysis."""
    return Study(*args, **kwargs).summary()
