"""Queries over result tables and files of several sites, settings and exports."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import astuple, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrate.operators import network as N
from spanrate.operators import report as R
from spanrate.operators.incidence import Settings
from spanrate.operators.ledger import is_task_required
from spanrate.plans.study import database_metadata, incidence_of_analyses
from spanrate.schemas import camel_case, literal_frame, rename_all, snake_case
from spanrate.sources import settings as T
from spanrate.sources.durable import new_folder, write_text
from spanrate.sources.keyed_tables import append_keyed, create_results, read_results, replace_sites
from spanrate.sources.tables import merged_sites, read_csv, read_site_files, save_incremental

from . import definitions as D
from .clinical import clinical, sites, table
from .incidence_queries import rounded, study_cohorts, summary_by_site, with_all
from .report_queries import tasks

Query = Callable[[SparkSession, str], DataFrame]

COUNT_SPEC = [
    N.FieldSpec("o_custkey", "bigint", primary_key=True),
    N.FieldSpec("o_orderpriority", "varchar(20)", primary_key=True),
    N.FieldSpec("o_orderstatus", "varchar(1)"),
    N.FieldSpec("n", "bigint"),
    N.FieldSpec("first_day", "date", optional=True),
]


def counted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", "o_orderpriority", "o_orderstatus")
        .agg(F.count("*").alias("n"), F.min(F.to_date("o_orderdate")).alias("first_day"))
    )


def appended(overwrite: bool) -> Query:
    """Finished, then open, then pending orders per customer and priority in one keyed table.

    The open ones come without the optional day, which stays in the table.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts, path = counted_orders(spark, sf_dir), new_folder(spark, "results")
        create_results(spark, path, COUNT_SPEC, buckets=8)
        for status in ("F", "O", "P"):
            new = counts.where(F.col("o_orderstatus") == status)
            append_keyed(new.drop("first_day") if status == "O" else new, path, COUNT_SPEC, overwrite)
        return read_results(spark, path, COUNT_SPEC)

    return run


SITE_SPEC = [
    N.FieldSpec("database_id", "varchar(20)", primary_key=True, empty_is_na=False),
    N.FieldSpec("cell", "bigint", primary_key=True),
    N.FieldSpec("release", "int"),
    N.FieldSpec("total", "float"),
]


def site_purged_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions send a second release, which replaces all they have sent, and send it again."""
    cells = (
        table(spark, sf_dir, "orders")
        .join(sites(spark, sf_dir), F.col("o_custkey") == F.col("subject_id"))
        .groupBy(F.col("database_name").alias("database_id"), F.col("o_custkey").alias("cell"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    )
    path = new_folder(spark, "sites")
    create_results(spark, path, SITE_SPEC, buckets=4)
    append_keyed(cells.withColumn("release", F.lit(1)), path, SITE_SPEC)
    second = cells.where("cell % 3 = 0 AND database_id IN ('ASIA', 'EUROPE')")
    second = second.withColumn("release", F.lit(2))
    for _ in range(2):
        replace_sites(second, path, SITE_SPEC, ["ASIA", "EUROPE"])
    return read_results(spark, path, SITE_SPEC)


FILE_SPEC = [
    N.FieldSpec("o_custkey", "bigint", primary_key=True),
    N.FieldSpec("o_orderpriority", "varchar(20)", primary_key=True),
    N.FieldSpec("o_orderstatus", "varchar(1)"),
    N.FieldSpec("n", "bigint"),
]


def file_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per order status, sorted; the first file, and in it the first record, of a key wins."""
    folder = new_folder(spark, "files")
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").alias("n")
    )
    for status in ("F", "O", "P"):
        # The files of a status follow each other by name as their ranges do.
        part = rows.where(F.col("o_orderstatus") == status)
        part = part.repartitionByRange(F.desc("n")).sortWithinPartitions(F.desc("n"))
        part.write.option("header", True).csv(f"{folder}/{status}")
    return merged_sites(spark, f"{folder}/*", FILE_SPEC, unique=True).select(
        "o_custkey", "o_orderpriority", "o_orderstatus", "n"
    )


TEXT_FILE_SPEC = [
    N.FieldSpec("doc_id", "bigint", primary_key=True),
    N.FieldSpec("text", "varchar"),
    N.FieldSpec("lang", "varchar(3)", optional=True),
]


def files_with_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the sites' CSV files, line breaks, quotes and all, some without the language."""
    folder = new_folder(spark, "texts")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    for number, has_lang in enumerate((True, False)):
        own = docs.where((F.col("doc_id") % 2 == 0) == has_lang)
        part = own.drop("source") if has_lang else own.drop("source", "lang")
        part.write.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(f"{folder}/{number}")
    rows = N.coerce_types(read_site_files(spark, f"{folder}/*", TEXT_FILE_SPEC), TEXT_FILE_SPEC)
    return rows.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def csv_keys_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by priority and status, exported, then the finished orders' replaced, twice.

    The file has snake case names; it is read back under the camel case ones it was written with.
    """
    totals = rename_all(
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", "o_orderstatus")
        .agg(F.count("*").alias("num_orders"), F.min(F.to_date("o_orderdate")).alias("first_day")),
        camel_case,
    )
    path = new_folder(spark, "export")
    save_incremental(totals, path, ["oOrderpriority", "oOrderstatus"])
    finished = totals.where("oOrderstatus = 'F'").withColumn("numOrders", -F.col("numOrders"))
    for _ in range(2):
        save_incremental(finished, path, ["oOrderpriority", "oOrderstatus"])
    stored = spark.read.option("header", True).csv(path).columns
    if stored != [snake_case(c) for c in totals.columns]:
        raise ValueError(f"the file has columns {stored}")
    return read_csv(spark, path, totals.schema)


def older_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of earlier releases: one with a column too many, one with a column too few."""
    orders = table(spark, sf_dir, "orders")
    cohort = orders.select(F.col("o_orderkey").alias("cohort_id"), F.col("o_custkey").alias("referent_concept_id"))
    values = orders.select(F.col("o_orderkey").alias("cohort_id"), F.lit("{}").alias("metadata"))
    old = N.older_layout(cohort.withColumn("metadata", F.lit("m")), "cohort")
    new = N.older_layout(values, "covariate_value")
    return old.unionByName(new, allowMissingColumns=True).select("cohort_id", "metadata", "sum_value")


def outcomes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the summary with the place their outcome has in the report's list."""
    order = literal_frame(
        spark, [("Medium", 1), ("High", 2), ("Unspecified", 3)], "outcome_name string, sort_order int"
    )
    cells = summary_by_site(spark, sf_dir).groupBy("outcome_name").agg(F.sum("num_outcomes").alias("n"))
    return R.with_sort_order(cells, order)


def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single tasks against a ledger of all documents: unchanged, changed, unknown."""
    ledger = tasks(spark, sf_dir)
    known = ledger.orderBy("doc_id").first()
    asked = [
        ("unchanged", is_task_required(ledger, {"doc_id": known.doc_id}, known.checksum)),
        ("changed", is_task_required(ledger, {"doc_id": known.doc_id}, "other")),
        ("unknown", is_task_required(ledger, {"doc_id": -1}, known.checksum)),
    ]
    rows = [(name, known.checksum, int(required)) for name, required in asked]
    return literal_frame(spark, rows, "task string, checksum string, required int")


def found_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database row where the vocabulary table names its release."""
    cdm = clinical(spark, sf_dir)
    named = cdm.vocabulary.withColumn(
        "vocabulary_id", F.when(F.col("vocabulary_id") == "ASIA", "None").otherwise(F.col("vocabulary_id"))
    )
    return database_metadata(replace(cdm, vocabulary=named), "db2", "Database two", "Named release")


def _settings_folder(spark: SparkSession) -> str:
    """The study's settings as the files that describe a study."""
    folder, s = new_folder(spark, "settings"), D.SETTINGS
    windows = ["time_at_risk_id", "time_at_risk_start_offset", "time_at_risk_start_index"]
    windows += ["time_at_risk_end_offset", "time_at_risk_end_index"]
    files = {
        "targets": (["cohortId", "cohortName"], [(t.target_cohort_definition_id, t.target_name) for t in s.targets]),
        "subgroups": (
            ["cohortId", "cohortName"],
            [(g.subgroup_cohort_definition_id, g.subgroup_name) for g in s.subgroups],
        ),
        "windows": (windows, [astuple(t) for t in s.tars]),
        "outcomes": (
            ["outcomeId", "outcomeCohortDefinitionId", "outcomeName", "cleanWindow", "excludedCohortDefinitionId"],
            [
                (o.outcome_id, o.outcome_cohort_definition_id, o.outcome_name, o.clean_window,
                 o.excluded_cohort_definition_id or "NA")
                for o in s.outcomes
            ],
        ),
    }
    for name, (header, rows) in files.items():
        lines = [",".join(header), *(",".join(f'"{v}"' for v in row) for row in rows)]
        write_text(spark, f"{folder}/{name}.csv", "\n".join(lines) + "\n")
    analyses = [
        {"name": "urgent", "targetIds": [101], "subgroupIds": [0, 41, 42], "timeAtRiskIds": [6, 7], "outcomeIds": [201, 203]},
        {"name": "calendar", "targetIds": [102], "subgroupIds": [51, 52], "timeAtRiskIds": [1], "outcomeIds": [202]},
    ]
    write_text(spark, f"{folder}/analyses.json", json.dumps({"analysisList": analyses}))
    return folder


def study_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two analyses whose settings and analysis list are read from files."""
    folder = _settings_folder(spark)
    rows = {n: T.settings_rows(spark, f"{folder}/{n}.csv") for n in ("targets", "subgroups", "windows", "outcomes")}
    settings = Settings(
        T.target_specs(rows["targets"]),
        T.tar_specs(rows["windows"]),
        T.subgroup_specs(rows["subgroups"]),
        T.outcome_specs(rows["outcomes"]),
    )
    listed = T.analyses(T.settings_text(spark, f"{folder}/analyses.json"))
    targets, outcomes, subgroups = study_cohorts(spark, sf_dir)
    out = incidence_of_analyses(
        clinical(spark, sf_dir), targets, outcomes, subgroups, with_all(settings), listed, "all"
    )
    return rounded(out)


def queries() -> dict[str, Query]:
    return {
        "append_results_replace": appended(True),
        "append_results_keep": appended(False),
        "site_purged_twice": site_purged_twice,
        "file_first_row": file_first_row,
        "files_with_line_breaks": files_with_line_breaks,
        "csv_keys_replaced": csv_keys_replaced,
        "older_layouts": older_layouts,
        "outcomes_in_order": outcomes_in_order,
        "task_status": task_status,
        "found_release": found_release,
        "study_from_files": study_from_files,
    }
