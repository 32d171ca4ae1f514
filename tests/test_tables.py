from __future__ import annotations

import csv

import pytest
from pyspark.sql import functions as F

from days import frame, plain
from spanrate.operators import incidence as I
from spanrate.operators import ledger as L
from spanrate.operators import network as N
from spanrate.operators.cohort import build_cohorts
from spanrate.operators.incidence import Settings
from spanrate.plans.recipes import clean_condition, concepts
from spanrate.plans.study import package_metadata, run_cohorts, run_study
from spanrate.schemas import (
    CLINICAL_DDL,
    COHORT_DDL,
    REFERENCE_DDL,
    camel_case,
    literal_frame,
    snake_case,
)
from spanrate.sources import settings as T
from spanrate.sources import durable as durable_module
from spanrate.sources.clinical import read_clinical_catalog, read_clinical_files
from spanrate.sources.durable import swap_table, use_work_dir, work_dir
from spanrate.sources.tables import (
    append_results,
    create_cohort_table,
    delete_cohort_range,
    merge_site_files,
    read_cohort_table,
    replace_site,
    write_cohorts,
)
from spanrate.specs import Analysis, OutcomeSpec, SubgroupSpec, TargetSpec, TarSpec
from test_cohorts import tables


def test_writing_a_cohort_replaces_it_and_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "cohort")
    create_cohort_table(spark, path)
    assert read_cohort_table(spark, path).count() == 0
    write_cohorts(frame(spark, [(1, 5, 1, 2), (20, 6, 1, 2)], COHORT_DDL), path, [1, 20])
    write_cohorts(frame(spark, [(1, 7, 3, 4)], COHORT_DDL), path, [1])
    assert plain(read_cohort_table(spark, path)) == [(1, 7, 3, 4), (20, 6, 1, 2)]
    # An empty result replaces an earlier one as well.
    write_cohorts(frame(spark, [], COHORT_DDL), path, [1])
    assert plain(read_cohort_table(spark, path)) == [(20, 6, 1, 2)]
    assert delete_cohort_range(spark, path, 10, 150) == [20]
    assert plain(read_cohort_table(spark, path)) == []


def test_only_changed_cohorts_are_rebuilt(spark, tmp_path):
    path = str(tmp_path / "cohort")
    cdm = tables(spark, [(1, 1, 10, None), (1, 2, 20, None)])
    specs = [clean_condition(1, "a", concepts(1)), clean_condition(2, "b", concepts(2))]
    due, ledger = run_cohorts(cdm, specs, path)
    assert due == [1, 2]
    assert plain(read_cohort_table(spark, path)) == [(1, 1, 10, 11), (2, 1, 20, 21)]
    changed = [specs[0], clean_condition(2, "b", concepts(2), exit_offset=5)]
    due, ledger = run_cohorts(cdm, changed, path, ledger)
    assert due == [2]
    assert plain(read_cohort_table(spark, path)) == [(1, 1, 10, 11), (2, 1, 20, 25)]
    assert ledger.count() == 2
    assert run_cohorts(cdm, changed, path, ledger)[0] == []


def test_ledger_of_single_tasks(spark):
    ledger = literal_frame(
        spark, [(1, "x"), (2, "y"), (2, "z")], "cohort_id long, checksum string"
    )
    assert L.is_task_required(None, {"cohort_id": 1}, "x")
    assert not L.is_task_required(ledger, {"cohort_id": 1}, "x")
    assert L.is_task_required(ledger, {"cohort_id": 1}, "new")
    assert L.is_task_required(ledger, {"cohort_id": 9}, "x")
    with pytest.raises(L.DuplicateTask):
        L.is_task_required(ledger, {"cohort_id": 2}, "y")
    with pytest.raises(L.DuplicateTask):
        L.check_ledger(ledger, ["cohort_id"])
    assert L.matching(ledger, ledger.select("cohort_id"), ["cohort_id", "other"]).count() == 0


SPEC = [
    N.FieldSpec("database_id", "varchar(20)", primary_key=True, empty_is_na=False),
    N.FieldSpec("cell", "bigint", primary_key=True, empty_is_na=False),
    N.FieldSpec("n", "int"),
    N.FieldSpec("note", "varchar", optional=True),
]


def write_file(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows(rows)


def test_site_files_are_checked_coerced_and_merged(spark, tmp_path):
    write_file(tmp_path / "a" / "t.csv", [["database_id", "cell", "n"], ["a", "1", "5"], ["a", "1", "6"], ["s", "2", "x"]])
    write_file(tmp_path / "b" / "t.csv", [["n", "note", "database_id", "cell"], ["7", "hi", "b", "1"], ["8", "", "s", "2"]])
    merged = merge_site_files(spark, f"{tmp_path}/*", SPEC)
    assert merged.columns == ["database_id", "cell", "n", "site_file", "note"]
    assert plain(merged, "database_id", "cell", "n", "note") == [
        ("a", 1, 5, None),
        ("a", 1, 6, None),
        ("b", 1, 7, "hi"),
        ("s", 2, None, None),
    ]
    once = merge_site_files(spark, f"{tmp_path}/*", SPEC, unique=True)
    assert plain(once, "database_id", "cell", "n") == [("a", 1, 5), ("b", 1, 7), ("s", 2, None)]
    write_file(tmp_path / "c" / "t.csv", [["database_id", "n"], ["a", "1"]])
    with pytest.raises(N.ColumnMismatch):
        merge_site_files(spark, f"{tmp_path}/*", SPEC)


def test_the_first_row_of_a_key_in_a_file_is_kept(spark, tmp_path):
    rows = [["database_id", "cell", "n"], *[["a", "1", str(n)] for n in (6, 5, 9, 1)]]
    write_file(tmp_path / "a" / "t.csv", rows)
    write_file(tmp_path / "b" / "t.csv", [["database_id", "cell", "n"], ["a", "1", "0"]])
    kept = merge_site_files(spark, f"{tmp_path}/*", SPEC, unique=True)
    assert plain(kept, "database_id", "cell", "n") == [("a", 1, 6)]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    literal_frame(spark, [("a", 1, 1)], "database_id string, cell long, n int").write.parquet(path)
    broken = spark.read.parquet(path).withColumn("n", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        swap_table(broken, path)
    assert plain(spark.read.parquet(path)) == [("a", 1, 1)]


def test_intermediate_tables_need_a_folder(spark, monkeypatch, tmp_path):
    class Bare:
        class conf:
            settings = {}

            @classmethod
            def get(cls, name, default=None):
                return cls.settings.get(name, default)

            @classmethod
            def set(cls, name, value):
                cls.settings[name] = value

    with pytest.raises(ValueError, match="share"):
        work_dir(Bare)
    use_work_dir(Bare, "/shared/")
    assert work_dir(Bare) == "/shared"
    Bare.conf.settings["spark.checkpoint.dir"] = "hdfs://first"
    assert work_dir(Bare) == "hdfs://first"


def test_intermediate_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(durable_module, "work_dir", lambda _: str(tmp_path))
    (tmp_path / "other").mkdir()
    durable_module.durable(spark.range(3))
    assert len(list(tmp_path.glob("spanrate-*"))) == 1
    durable_module.clear_work_dir(spark)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["other"]


def test_null_keys_are_settled_once(spark):
    old = literal_frame(spark, [(None, 1)], "database_id string, n int")
    assert N.append_new_rows(old, old, ["database_id"]).count() == 1
    for overwrite in (True, False):
        kept, added = N.split_conflicts(old, old, ["database_id"], overwrite)
        assert kept.unionByName(added).count() == 1


def test_results_are_appended_by_key(spark, tmp_path):
    ddl = "database_id string, cell long, n int"
    spec = SPEC[:3]
    for overwrite, expected in ((None, 9), (False, 1)):
        path = str(tmp_path / f"r{overwrite}")
        literal_frame(spark, [("a", 1, 1), ("a", 2, 2)], ddl).write.parquet(path)
        new = literal_frame(spark, [("a", 1, 9), ("a", 1, 9), ("b", 1, 3), (None, None, 4)], ddl)
        append_results(new, path, spec, overwrite)
        assert plain(spark.read.parquet(path).select("database_id", "cell", "n")) == [
            ("", 0, 4),
            ("a", 1, expected),
            ("a", 2, 2),
            ("b", 1, 3),
        ]


def test_a_site_is_replaced_whole(spark, tmp_path):
    path, ddl = str(tmp_path / "s"), "database_id string, cell long"
    replace_site(literal_frame(spark, [("a", 1), ("a", 2), ("b", 1)], ddl), path)
    replace_site(literal_frame(spark, [("a", 7)], ddl), path)
    assert plain(spark.read.parquet(path), "database_id", "cell") == [("a", 7), ("b", 1)]


def test_merge_keeps_rows_of_the_first_file_with_null_keys(spark):
    ddl = "database_id string, cell long, n int"
    files = [
        ("1.csv", literal_frame(spark, [(None, 1, 1)], ddl)),
        ("2.csv", literal_frame(spark, [(None, 1, 2), ("b", 1, 3)], ddl)),
    ]
    assert plain(N.merge_sites(files, SPEC), "database_id", "cell", "n") == [("b", 1, 3), (None, 1, 1)]


def test_older_layouts(spark):
    df = literal_frame(spark, [(1, None, 2)], "id long, name string, referent_concept_id long")
    row = N.older_layout(df, "cohort").collect()[0]
    assert row.asDict() == {
        "id": 1,
        "name": None,
        "metadata": '{"id":1,"name":null,"referent_concept_id":2}',
    }
    assert N.older_layout(df, "covariate_value").collect()[0].sum_value == -1.0


def test_names():
    assert snake_case("numPersonsAtRisk") == "num_persons_at_risk"
    assert snake_case("incidenceRateP100py") == "incidence_rate_p_100py"
    assert camel_case("incidence_rate_p_100py") == "incidenceRateP100py"


def test_settings_files(tmp_path):
    path = tmp_path / "outcomes.csv"
    header = ["outcomeId", "outcomeCohortDefinitionId", "outcomeName", "cleanWindow", "excludedCohortDefinitionId"]
    write_file(path, [header, ["5", "5", "O", "30", "6"], ["7", "7", "P", "", "NA"]])
    specs = T.outcome_specs(T.read_settings(path))
    assert [(s.outcome_id, s.clean_window, s.excluded_cohort_definition_id) for s in specs] == [
        (5, 30, 6),
        (7, 0, None),
    ]
    (analysis,) = T.analyses(
        '{"analysisList": [{"name": "a", "targetIds": [1], "subgroupIds": [21],'
        ' "timeAtRiskIds": [1], "outcomeIds": [5]}]}'
    )
    assert analysis == Analysis("a", (1,), (21,), (1,), (5,))


def test_clinical_tables_from_files_and_catalog(spark, tmp_path):
    cdm = tables(spark, [(1, 1, 10, None)], persons=[(1, 8532, 1990)])
    spark.sql(f"CREATE DATABASE IF NOT EXISTS cdm_test LOCATION '{tmp_path}/db'")
    for name in CLINICAL_DDL:
        df = getattr(cdm, name)
        df.write.parquet(f"{tmp_path}/parquet/{name}")
        df.write.option("header", True).csv(f"{tmp_path}/csv/{name}")
        # A catalog table may have more columns than the engine reads.
        df.withColumn("extra", F.lit(1)).write.mode("overwrite").saveAsTable(f"cdm_test.{name}")
    specs = [clean_condition(1, "a", concepts(1))]
    for read in (
        read_clinical_files(spark, f"{tmp_path}/parquet"),
        read_clinical_files(spark, f"{tmp_path}/csv", "csv"),
        read_clinical_catalog(spark, "cdm_test", "cdm_test"),
    ):
        assert plain(build_cohorts(read, specs)) == [(1, 1, 10, 11)]
    spark.sql("DROP DATABASE cdm_test CASCADE")


def test_reference_frames_of_the_settings(spark, tmp_path):
    path = tmp_path / "tar.csv"
    names = ["id", "start_offset", "start_index", "end_offset", "end_index"]
    write_file(path, [[f"time_at_risk_{n}" for n in names], *map(list, TIME_AT_RISK_ROWS)])
    tars = T.tar_specs(T.read_settings(path))
    assert plain(I.tar_frame(spark, tars)) == [(1, 0, 0, 2, 0), (6, 1, 0, 90, 0)]
    read = T.read_settings_frame(spark, str(path), REFERENCE_DDL["time_at_risk"])
    assert plain(read) == plain(I.tar_frame(spark, tars))
    assert plain(I.target_frame(spark, T.target_specs([{"cohortId": "1", "cohortName": "T"}]))) == [
        (1, "T")
    ]
    assert T.subgroup_specs([{"cohortId": "21", "cohortName": "S"}]) == [SubgroupSpec(21, "S")]


TIME_AT_RISK_ROWS = [(1, 0, 0, 2, 0), (6, 1, 0, 90, 0)]


def test_a_study_from_tables_to_export(spark, tmp_path):
    cdm = tables(
        spark,
        [(1, 1, 10, None), (1, 2, 20, None), (2, 1, 40, None)],
        periods=[(1, 1, 1, 700), (2, 2, 1, 700)],
        persons=[(1, 8532, 1990), (2, 8507, 1950)],
    )
    folder = str(tmp_path)
    settings = Settings(
        [TargetSpec(1, "T")],
        [TarSpec(6, 1, 0, 90, 0)],
        [SubgroupSpec(31, "Girls"), SubgroupSpec(52, "Men")],
        [OutcomeSpec(5, 5, "O", 30)],
    )
    analysis = Analysis("a", (1,), (31, 52), (6,), (5,))

    def run(outcome=concepts(2)):
        run_study(
            cdm,
            [clean_condition(1, "T", concepts(1))],
            [clean_condition(5, "O", outcome)],
            settings,
            [analysis],
            folder,
            "db",
            "Database",
            work_dir=f"{folder}/work",
        )

    def ledger(kind):
        return {r.cohort_id: r.time_stamp for r in spark.read.parquet(f"{folder}/ledger/{kind}").collect()}

    expected = [("All", 2, 1), ("Girls", 1, 1), ("Men", 1, 0)]
    run()
    first = {kind: ledger(kind) for kind in ("target", "outcome")}
    # A second run builds nothing anew and leaves the summary as it is; a changed cohort is built.
    run()
    assert first == {kind: ledger(kind) for kind in ("target", "outcome")}
    summary = spark.read.parquet(f"{folder}/summary")
    assert plain(summary, "subgroup_name", "num_persons_at_risk", "num_outcomes") == expected
    run(concepts(3))
    assert ledger("target") == first["target"] and ledger("outcome") != first["outcome"]
    assert {r.num_outcomes for r in spark.read.parquet(f"{folder}/summary").collect()} == {0}
    record = spark.read.option("header", True).csv(f"{folder}/export/package").collect()[0]
    assert record.package_id == "package" and '"targets":"1"' in record.params.replace("\\", "")
    exported = spark.read.option("header", True).csv(f"{folder}/export/incidence_analysis")
    assert {r.num_persons_at_risk for r in exported.collect()} == {"-5"}
    database = spark.read.option("header", True).csv(f"{folder}/export/database").collect()[0]
    assert (database.vocabulary_version, database.database_id) == ("UNKNOWN", "db")
    params = package_metadata(spark, "p", "1", {"folder": folder}).collect()[0].params
    assert params == f'{{"folder":"{folder}"}}'
    with pytest.raises(ValueError):
        analysis = Analysis("b", (9,), (), (6,), (5,))
        run_study(cdm, [], [], settings, [analysis], folder, "db", "d", work_dir=f"{folder}/work")


def test_checksum_is_md5_of_the_text(spark):
    df = literal_frame(spark, [("abc",)], "t string").select(L.checksum(F.col("t")).alias("c"))
    assert df.collect()[0].c == "900150983cd24fb0d6963f7d28e17f72"
