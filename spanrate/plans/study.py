"""A whole study at one site: cohorts, incidence, export."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohort import build_cohorts
from ..operators.disclosure import MIN_CELL_COUNT, min_cell
from ..operators.incidence import SHARED_ANALYSES, Settings, incidence
from ..operators.ledger import check_ledger, record_tasks, required_tasks
from ..operators.subgroups import age_sex_subgroups, subgroup_specs
from ..schemas import literal_frame
from ..sources.clinical import ClinicalTables
from ..sources.durable import durable, swap_table, use_work_dir
from ..sources.tables import (
    create_cohort_table,
    delete_cohort_range,
    read_cohort_table,
    read_ledger,
    write_cohorts,
    write_csv,
    write_summary,
)
from ..specs import Analysis, CohortSpec, check_analysis

TASK_KEY = ["cohort_id"]


def task_frame(spark: SparkSession, specs: Sequence[CohortSpec]) -> DataFrame:
    """One row per cohort with the md5 of its definition."""
    rows = [(s.cohort_id, s.checksum()) for s in specs]
    return literal_frame(spark, rows, "cohort_id long, checksum string")


def run_cohorts(
    cdm: ClinicalTables,
    specs: Sequence[CohortSpec],
    cohort_path: str,
    ledger: DataFrame | None = None,
) -> tuple[list[int], DataFrame]:
    """Build the cohorts whose definition changed; returns their ids and the new ledger."""
    spark = cdm.person.sparkSession
    if not specs:
        if ledger is None:
            create_cohort_table(spark, cohort_path)
        return [], ledger if ledger is not None else record_tasks(None, task_frame(spark, []), TASK_KEY)
    tasks = task_frame(spark, specs)
    if ledger is not None:
        check_ledger(ledger, TASK_KEY)
    else:
        create_cohort_table(spark, cohort_path)
    due = {r.cohort_id for r in required_tasks(tasks, ledger, TASK_KEY).collect()}
    todo = [s for s in specs if s.cohort_id in due]
    if todo:
        write_cohorts(build_cohorts(cdm, todo), cohort_path, [s.cohort_id for s in todo])
    done = task_frame(spark, todo)
    return sorted(due), record_tasks(ledger, done, TASK_KEY)


def run_subgroups(cdm: ClinicalTables, path: str) -> None:
    """Subgroup cohorts are rebuilt on every run."""
    create_cohort_table(cdm.person.sparkSession, path)
    delete_cohort_range(cdm.person.sparkSession, path, 10, 150)
    cohorts = age_sex_subgroups(cdm.person, cdm.observation_period)
    write_cohorts(cohorts, path, [s.subgroup_cohort_definition_id for s in subgroup_specs()])


def incidence_of_analyses(
    cdm: ClinicalTables,
    targets: DataFrame,
    outcomes: DataFrame,
    subgroups: DataFrame,
    settings: Settings,
    analyses: Sequence[Analysis],
    database_name: str = "",
    sites: DataFrame | None = None,
) -> DataFrame:
    """The summaries of all analyses as in a results table: a cell that two report is there twice.

    They are built at once (``Study``), so that a further analysis costs its own cells only.
    """
    for analysis in analyses:
        missing = [
            n
            for n in check_analysis(
                analysis, settings.targets, settings.subgroups, settings.tars, settings.outcomes
            )
            if n.endswith("is not defined")
        ]
        if missing:
            raise ValueError(f"analysis {analysis.name!r}: {'; '.join(missing)}")
    shared = [
        list(analyses[i : i + SHARED_ANALYSES]) for i in range(0, len(analyses), SHARED_ANALYSES)
    ]
    frames = []
    for some in shared:
        merged = Analysis(
            "all",
            *(
                tuple(dict.fromkeys(i for a in some for i in getattr(a, ids)))
                for ids in ("target_ids", "subgroup_ids", "time_at_risk_ids", "outcome_ids")
            ),
        )
        frames.append(
            durable(
                incidence(
                    cdm.observation_period,
                    targets,
                    outcomes,
                    subgroups,
                    settings.chosen_by(merged),
                    database_name,
                    sites,
                    analyses=some,
                )
            )
        )
    return reduce(DataFrame.unionByName, frames)


def database_metadata(
    cdm: ClinicalTables, database_id: str, database_name: str, description: str
) -> DataFrame:
    """One row about the database: vocabulary release and observed dates."""
    release = cdm.vocabulary.where("vocabulary_id = 'None'").selectExpr(
        "vocabulary_version", "CAST(NULL AS DATE) AS first_day", "CAST(NULL AS DATE) AS last_day"
    )
    observed = cdm.observation_period.selectExpr(
        "CAST(NULL AS STRING) AS vocabulary_version",
        "observation_period_start_date AS first_day",
        "observation_period_end_date AS last_day",
    )
    facts = release.unionByName(observed).agg(
        F.coalesce(F.max("vocabulary_version"), F.lit("UNKNOWN")).alias("vocabulary_version"),
        F.min("first_day").alias("min_obs_period_date"),
        F.max("last_day").alias("max_obs_period_date"),
    )
    return facts.select(
        F.lit(database_id).alias("database_id"),
        F.lit(database_name).alias("database_name"),
        F.lit(description).alias("description"),
        "vocabulary_version",
        "min_obs_period_date",
        "max_obs_period_date",
        F.lit(0).alias("is_meta_analysis"),
    )


def package_metadata(
    spark: SparkSession, package_id: str, version: str, params: dict[str, str]
) -> DataFrame:
    """One row about the run, with its parameters as JSON."""
    fields = [F.lit(v).alias(k) for k, v in params.items()]
    return spark.range(1).select(
        F.lit(package_id).alias("package_id"),
        F.lit(version).alias("package_version"),
        F.current_timestamp().alias("execution_date"),
        F.to_json(F.struct(*fields)).alias("params"),
    )


def run_study(
    cdm: ClinicalTables,
    target_specs: Sequence[CohortSpec],
    outcome_specs: Sequence[CohortSpec],
    settings: Settings,
    analyses: Sequence[Analysis],
    folder: str,
    database_id: str,
    database_name: str,
    description: str = "",
    minimum: int = MIN_CELL_COUNT,
    *,
    work_dir: str,
    package: tuple[str, str] = ("package", "0"),
) -> None:
    """Cohorts to exported, censored results under ``folder``, which all machines share.

    Ledgers of what was built are kept under ``folder/ledger`` and used by later runs, in other
    sessions too.  A repeated run leaves the same summary.  ``work_dir`` takes intermediate
    tables; ``clear_work_dir`` removes them.
    """
    spark = cdm.person.sparkSession
    use_work_dir(spark, work_dir)
    _run_with_ledger(cdm, target_specs, folder, "target")
    run_subgroups(cdm, f"{folder}/subgroup_cohort")
    _run_with_ledger(cdm, outcome_specs, folder, "outcome")
    kinds = ("target", "outcome", "subgroup")
    tables = [read_cohort_table(spark, f"{folder}/{t}_cohort") for t in kinds]
    write_summary(
        incidence_of_analyses(cdm, *tables, settings, analyses, database_name), f"{folder}/summary"
    )
    summary = spark.read.parquet(f"{folder}/summary")
    write_csv(min_cell(summary, minimum=minimum), f"{folder}/export/incidence_analysis")
    params = {
        "databaseId": database_id,
        "databaseName": database_name,
        "description": description,
        "minCellCount": str(minimum),
        "targets": ",".join(str(s.cohort_id) for s in target_specs),
        "outcomes": ",".join(str(s.cohort_id) for s in outcome_specs),
        "analyses": ",".join(a.name for a in analyses),
    }
    write_csv(package_metadata(spark, *package, params), f"{folder}/export/package")
    if cdm.vocabulary is not None:
        write_csv(
            database_metadata(cdm, database_id, database_name, description),
            f"{folder}/export/database",
        )


def _run_with_ledger(
    cdm: ClinicalTables, specs: Sequence[CohortSpec], folder: str, kind: str
) -> None:
    path = f"{folder}/ledger/{kind}"
    before = read_ledger(cdm.person.sparkSession, path)
    _, after = run_cohorts(cdm, specs, f"{folder}/{kind}_cohort", before)
    swap_table(after, path)
