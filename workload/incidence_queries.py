"""Queries over person-time, incidence and disclosure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrate.functions.dates import days_between
from spanrate.operators import incidence as I
from spanrate.operators.cohort import build_cohorts
from spanrate.operators.disclosure import censored_share, min_cell
from spanrate.operators.intervals import interval_union
from spanrate.operators.subgroups import age_sex_subgroups
from spanrate.plans.study import database_metadata, incidence_of_analyses, run_study
from spanrate.sources.durable import new_folder, work_dir
from spanrate.sources.reuse import reused
from spanrate.specs import Analysis, SubgroupSpec

from . import definitions as D
from .clinical import clinical, raw_tables, sites, table

Query = Callable[[SparkSession, str], DataFrame]


def study_cohorts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Target, outcome and subgroup cohorts."""
    cdm = clinical(spark, sf_dir)
    specs = [D.TARGET_EVENTS, D.TARGET_CALENDAR, *D.OUTCOMES]
    definition = [s.checksum() for s in specs]
    built = reused("cohorts", raw_tables(spark, sf_dir), definition, lambda: build_cohorts(cdm, specs))
    is_target = F.col("cohort_definition_id").isin(101, 102)
    subgroups = age_sex_subgroups(cdm.person, cdm.observation_period)
    return built.where(is_target), built.where(~is_target), subgroups


def frames(spark: SparkSession, sf_dir: str) -> I.Study:
    targets, outcomes, subgroups = study_cohorts(spark, sf_dir)
    period = clinical(spark, sf_dir).observation_period
    return I.Study(period, targets, outcomes, subgroups, D.SETTINGS, "all")


def summary_by_site(
    spark: SparkSession, sf_dir: str, settings: I.Settings = D.SETTINGS
) -> DataFrame:
    """The results table of all sites, written as a site would write it."""

    def build() -> DataFrame:
        cohorts = study_cohorts(spark, sf_dir)
        period = clinical(spark, sf_dir).observation_period
        return I.incidence(period, *cohorts, settings, sites=sites(spark, sf_dir))

    specs = [s.checksum() for s in (D.TARGET_EVENTS, D.TARGET_CALENDAR, *D.OUTCOMES)]
    return reused("site-summary", raw_tables(spark, sf_dir), [repr(settings), specs], build)


def incidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, outcomes, subgroups = study_cohorts(spark, sf_dir)
    period = clinical(spark, sf_dir).observation_period
    return rounded(I.incidence(period, targets, outcomes, subgroups, D.SETTINGS, "all"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits, as the oracle has them."""
    return df.withColumns(
        {
            f.name: F.round(f"`{f.name}`", digits)
            for f in df.schema
            if f.dataType.simpleString() == "double"
        }
    )


def tar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, _, _ = study_cohorts(spark, sf_dir)
    return I.time_at_risk(targets, clinical(spark, sf_dir).observation_period, D.TARS)


def at_risk_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).eras


def event_day_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-day spells of every user and event type, merged where they overlap."""
    day = F.to_date("ts")
    spells = table(spark, sf_dir, "events").select(
        "user_id",
        "event_type",
        day.alias("start_date"),
        F.date_add(day, (F.length("event_type") % 4).cast("int")).alias("end_date"),
    )
    return interval_union(spells, ["user_id", "event_type"])


def event_user_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of activity per user, joined over gaps of up to two days."""
    day = F.to_date("ts")
    spells = table(spark, sf_dir, "events").select(
        "user_id", day.alias("start_date"), day.alias("end_date")
    )
    return interval_union(spells, ["user_id"], touch=True, pad=2)


def excluded_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, outcomes, _ = study_cohorts(spark, sf_dir)
    return I.excluded_periods(outcomes, D.SETTINGS.outcomes)


def excluded_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).excluded.drop("database_name")


def era_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).within.drop("database_name")


def cells(pick: Callable[[I.Study], DataFrame], overall: bool | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = pick(frames(spark, sf_dir)).drop("database_name")
        whole = F.col("subgroup_cohort_definition_id") == 0
        return out if overall is None else out.where(whole if overall else ~whole)

    return run


def at_risk(f: I.Study) -> DataFrame:
    years = I.person_years(F.col("days_at_risk"))
    return I.at_risk_cells(f.per_person).withColumn("person_years", years)


def excluded_time(f: I.Study) -> DataFrame:
    years = I.person_years(F.col("excluded_days"))
    return I.excluded_time_cells(f.cells).withColumn("person_years", years)


def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days at risk, excluded and left per target, window and outcome."""
    f = frames(spark, sf_dir)
    spent = f.excluded.groupBy(*I.DESIGN, "outcome_id").agg(
        F.sum(days_between("start_date", "end_date")).alias("excluded_days")
    )
    total = f.eras.groupBy(*I.DESIGN).agg(
        F.sum(days_between("era_start", "era_end")).alias("days")
    )
    return total.join(spent, I.DESIGN).withColumn(
        "days_left", F.col("days") - F.col("excluded_days")
    )


def incidence_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(min_cell(summary_by_site(spark, sf_dir)))


def incidence_blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(min_cell(summary_by_site(spark, sf_dir), blank_rates=True)).select(
        *I.CELL, "num_outcomes", "incidence_proportion_p100p", "incidence_rate_p100py"
    )


def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return censored_share(summary_by_site(spark, sf_dir))


def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    cdm = clinical(spark, sf_dir)
    return database_metadata(cdm, "db1", "Database one", "All customers")


ANALYSES = [
    Analysis("urgent", (101,), (0, 41, 42), (6, 7), (201, 203)),
    Analysis("calendar", (102,), (51, 52), (1,), (202,)),
]


def two_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two analyses of one study, stacked as in its results table."""
    targets, outcomes, subgroups = study_cohorts(spark, sf_dir)
    cdm = clinical(spark, sf_dir)
    out = incidence_of_analyses(
        cdm, targets, outcomes, subgroups, with_all(D.SETTINGS), ANALYSES, "all"
    )
    return rounded(out)


def with_all(settings: I.Settings) -> I.Settings:
    """Subgroup 0, everybody, is always reported and may be named in an analysis."""
    everybody = SubgroupSpec(0, "All")
    return I.Settings(
        settings.targets, settings.tars, [everybody, *settings.subgroups], settings.outcomes
    )


def study_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary that a whole study leaves when it is run again on the same folder."""
    folder = new_folder(spark, "study")
    settings = I.Settings(
        D.SETTINGS.targets[1:], [D.TARS[6]], D.SETTINGS.subgroups[4:6], D.SETTINGS.outcomes[:1]
    )
    subgroups = tuple(s.subgroup_cohort_definition_id for s in settings.subgroups)
    analysis = Analysis("again", (102,), subgroups, (7,), (201,))
    for _ in range(2):
        run_study(
            clinical(spark, sf_dir),
            [D.TARGET_CALENDAR],
            [D.OUTCOMES[0]],
            settings,
            [analysis],
            folder,
            "all",
            "all",
            work_dir=work_dir(spark),
        )
    return rounded(spark.read.parquet(f"{folder}/summary"))


def queries() -> dict[str, Query]:
    return {
        "incidence_two_analyses": two_analyses,
        "study_twice": study_twice,
        "tar_windows": tar_windows,
        "interval_union": at_risk_eras,
        "event_day_eras": event_day_eras,
        "event_user_eras": event_user_eras,
        "exclusion_periods": excluded_periods,
        "interval_intersect": excluded_at_risk,
        "interval_containment": era_exclusions,
        "at_risk_overall": cells(at_risk, True),
        "at_risk_subgroup": cells(at_risk, False),
        "outcomes_overall": cells(lambda f: I.outcome_cells(f.cells), True),
        "outcomes_subgroup": cells(lambda f: I.outcome_cells(f.cells), False),
        "excluded_person_time": cells(excluded_time),
        "excluded_persons": cells(lambda f: I.excluded_person_cells(f.cells)),
        "excluded_outcomes": cells(lambda f: I.excluded_outcome_cells(f.cells)),
        "persons_losing_outcome": cells(lambda f: I.lost_outcome_cells(f.cells)),
        "remaining_time": remaining_time,
        "incidence_summary": incidence_summary,
        "incidence_censored": incidence_censored,
        "incidence_blanked": incidence_blanked,
        "censored_share": share,
        "run_metadata": run_metadata,
    }
