"""Keyed result tables, site files with records of several lines, swaps that were cut off."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from days import plain
from spanrate.operators import network as N
from spanrate.schemas import literal_frame, struct_type
from spanrate.sources import durable, keyed_tables, reuse
from spanrate.sources.keyed_tables import DuplicateKeys, append_keyed, create_results, read_results, replace_sites
from spanrate.sources.tables import append_results, merge_site_files, merged_sites, read_csv, read_ledger, save_incremental

SPEC = [
    N.FieldSpec("database_id", "varchar(20)", primary_key=True, empty_is_na=False),
    N.FieldSpec("cell", "bigint", primary_key=True, empty_is_na=False),
    N.FieldSpec("n", "int"),
    N.FieldSpec("note", "varchar", optional=True),
]
FULL = "database_id string, cell long, n int, note string"
BARE = "database_id string, cell long, n int"


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


@pytest.fixture()
def results(spark, tmp_path):
    path = str(tmp_path / "results")
    create_results(spark, path, SPEC, buckets=4)
    rows = [(site, cell, cell, f"note {cell}") for site in ("a", "b c", "") for cell in range(20)]
    append_keyed(literal_frame(spark, rows, FULL), path, SPEC)
    return path


def test_an_empty_keyed_table(spark, tmp_path):
    path = str(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        read_results(spark, path, SPEC)
    create_results(spark, path, SPEC)
    assert read_results(spark, path, SPEC).count() == 0
    append_keyed(literal_frame(spark, [], FULL), path, SPEC)
    assert read_results(spark, path, SPEC).columns == ["database_id", "cell", "n", "note"]
    with pytest.raises(ValueError, match="primary key"):
        create_results(spark, path, SPEC[2:])


@pytest.mark.parametrize("overwrite", [None, False])
def test_only_touched_buckets_are_written(spark, results, overwrite):
    before = files(results)
    append_keyed(literal_frame(spark, [("a", 3, 99), ("a", 3, 99)], BARE), results, SPEC, overwrite)
    after = files(results)
    if overwrite is False:  # the old row stays, so nothing is new
        assert after == before
    else:
        (gone,), (fresh,) = before - after, after - before
        assert Path(gone).parent == Path(fresh).parent
    rows = {(r.database_id, r.cell): (r.n, r.note) for r in read_results(spark, results, SPEC).collect()}
    assert len(rows) == 60 and rows["", 7] == (7, "note 7")
    assert rows["a", 3] == ((3, "note 3") if overwrite is False else (99, None))


def test_columns_are_kept_and_unknown_ones_refused(spark, results, tmp_path):
    append_keyed(literal_frame(spark, [("z", 1, 1)], BARE), results, SPEC)
    longer = [*SPEC, N.FieldSpec("extra", "float", optional=True)]
    append_keyed(literal_frame(spark, [("z", 2, 1)], BARE).withColumn("extra", F.lit(2.5)), results, longer)
    rows = {(r.database_id, r.cell): (r.note, r.extra) for r in read_results(spark, results, longer).collect()}
    assert rows["a", 1] == ("note 1", None) and rows["z", 2] == (None, 2.5) and len(rows) == 62
    with pytest.raises(N.ColumnMismatch, match="outside the specification: note"):
        read_results(spark, str(results), SPEC[:3])
    with pytest.raises(N.ColumnMismatch):
        append_keyed(literal_frame(spark, [("z", 1)], "database_id string, cell long"), results, SPEC)
    with pytest.raises(N.ColumnMismatch, match="laid out"):
        read_results(spark, results, [SPEC[1], *SPEC[2:]])


def test_a_plain_table_keeps_columns_that_new_rows_lack(spark, tmp_path):
    path = str(tmp_path / "plain")
    for overwrite, kept in ((True, {("a", 1): (9, None), ("a", 2): (2, "y")}), (False, {("a", 1): (1, "x"), ("a", 2): (2, "y")})):
        literal_frame(spark, [("a", 1, 1, "x"), ("a", 2, 2, "y")], FULL).write.mode("overwrite").parquet(path)
        append_results(literal_frame(spark, [("a", 1, 9)], BARE), path, SPEC, overwrite)
        assert {(r.database_id, r.cell): (r.n, r.note) for r in spark.read.parquet(path).collect()} == kept
    literal_frame(spark, [("a", 1, 1)], BARE).write.mode("overwrite").parquet(path)
    append_results(literal_frame(spark, [("b", 1, 9, "new")], FULL), path, SPEC, False)
    assert plain(spark.read.parquet(path), "database_id", "note") == [("a", None), ("b", "new")]
    literal_frame(spark, [("a", 1, 1, 5)], f"{BARE}, other int").write.mode("overwrite").parquet(path)
    with pytest.raises(N.ColumnMismatch, match="other"):
        append_results(literal_frame(spark, [("b", 1, 9)], BARE), path, SPEC)


def test_a_failing_write_changes_nothing(spark, results):
    before = files(results)
    rows = literal_frame(spark, [("a", 3, 99)], BARE)
    broken = rows.withColumn("n", F.when(F.col("cell") == 3, F.raise_error(F.lit("broken")).cast("int")))
    with pytest.raises(Exception, match="broken"):
        append_keyed(broken, results, SPEC)
    assert files(results) == before and read_results(spark, results, SPEC).count() == 60
    assert not list(Path(results).parent.glob("*.stage-*"))


def test_doubled_keys_are_not_published(spark, results):
    before = files(results)
    place = {"key_bucket": F.lit(0), "site_part": F.lit("s61")}
    twice = literal_frame(spark, [("a", 3, 1, None), ("a", 3, 2, None)], FULL).withColumns(place)
    with pytest.raises(DuplicateKeys):
        keyed_tables._stage(twice, results, SPEC)
    assert files(results) == before


@pytest.mark.parametrize("moves", [0, 1, 2, 3])
def test_a_change_cut_off_while_it_is_published_is_finished(spark, results, monkeypatch, moves):
    """The driver is lost after some of the moves; the next reader finds all of the change."""
    done = 0

    def failing(*args):
        nonlocal done
        if done == moves:
            raise KeyboardInterrupt
        done += 1
        durable.move(*args)

    monkeypatch.setattr(keyed_tables, "move", failing)
    new = [("a", cell, -cell, None) for cell in range(10, 30)]
    with pytest.raises(KeyboardInterrupt):
        replace_sites(literal_frame(spark, new, FULL), results, SPEC)
    monkeypatch.setattr(keyed_tables, "move", durable.move)
    rows = read_results(spark, results, SPEC)
    assert plain(rows.where("database_id = 'a'"), "cell", "n") == sorted((c, -c) for c in range(10, 30))
    assert rows.count() == 60 and not list(Path(results).parent.glob("*.stage-*"))


def test_a_site_is_purged_and_comes_back(spark, results):
    before = {f for f in files(results) if "site_part=s61/" not in f}
    new = literal_frame(spark, [("a", 100, 1, None)], FULL)
    for _ in range(2):
        replace_sites(new, results, SPEC)
        assert plain(read_results(spark, results, SPEC).where("database_id = 'a'"), "cell") == [(100,)]
    replace_sites(new.limit(0), results, SPEC, ["a", "never seen"])
    assert read_results(spark, results, SPEC).count() == 40 and files(results) == before
    with pytest.raises(ValueError, match="not purged"):
        replace_sites(new, results, SPEC, ["b c"])


TEXTS = [N.FieldSpec("id", "bigint", primary_key=True), N.FieldSpec("text", "varchar"), N.FieldSpec("extra", "int", optional=True)]


def test_records_of_several_lines(spark, tmp_path):
    (tmp_path / "x").mkdir(), (tmp_path / "y").mkdir()
    long = "line\n" * 5000
    (tmp_path / "x" / "1.csv").write_text(
        f'id,text\r\n1,"two\nlines"\r\n2,"a ""quote"", a comma"\n\n3,\n4,"{long}"\n5\n', newline=""
    )
    (tmp_path / "x" / "2.csv").write_text("﻿text,extra,id\nfirst,7,1\nünï,x,9\n", encoding="utf-8")
    (tmp_path / "x" / "note.txt").write_text("no table")
    (tmp_path / "x" / "_hidden.csv").write_text("a,b\n")
    rows = merge_site_files(spark, str(tmp_path / "*"), TEXTS)
    assert plain(rows, "id", "text", "extra") == [
        (1, "two\nlines", None),
        (2, 'a "quote", a comma', None),
        (3, None, None),
        (4, long, None),
        (5, None, None),
        (9, "ünï", None),
    ]
    assert rows.rdd.getNumPartitions() >= 1 and rows.columns == ["id", "text", "site_file", "extra"]
    (tmp_path / "y" / "3.csv").write_text('id,text\n1,a,b\n')
    with pytest.raises(Exception, match="record 1 of .*3.csv has 3 fields"):
        merge_site_files(spark, str(tmp_path / "*"), TEXTS).collect()
    (tmp_path / "y" / "3.csv").write_text('id,word\n1,a\n')
    with pytest.raises(N.ColumnMismatch, match="3.csv"):
        merge_site_files(spark, str(tmp_path / "*"), TEXTS)
    with pytest.raises(FileNotFoundError):
        merge_site_files(spark, str(tmp_path / "z"), TEXTS)


def test_records_are_numbered_by_file(spark, tmp_path):
    from spanrate.sources.tables import read_site_files

    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("id,text\n" + "".join(f'{i},"x\ny"\n' for i in range(25_000)))
    rows = read_site_files(spark, str(tmp_path), TEXTS)
    found = rows.groupBy("site_file").agg(
        F.count("*"), F.min("site_line"), F.max("site_line"), F.sum(F.col("site_line") - F.col("id").cast("long"))
    )
    assert [tuple(r)[1:] for r in found.collect()] == [(25_000, 1, 25_000, 25_000)] * 2


def test_a_cut_off_swap_is_finished_or_taken_back(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda n: literal_frame(spark, [(n,)], "n int")
    durable.swap_table(rows(1), path)
    # Lost between the moves: the old content is away and the new one complete.
    rows(2).write.parquet(f"{path}.new-x")
    os.rename(path, f"{path}.old-x")
    assert read_ledger(spark, path).collect()[0].n == 2
    # Lost while writing: the new content is not complete.
    (tmp_path / "t.new-y").mkdir()
    assert read_ledger(spark, path).collect()[0].n == 2
    # Lost between the moves, and the new content is gone.
    os.rename(path, f"{path}.old-z")
    assert read_ledger(spark, path).collect()[0].n == 2
    durable.swap_table(rows(3), path)
    assert spark.read.parquet(path).collect()[0].n == 3
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    assert read_ledger(spark, f"{path}-none") is None


def test_exported_rows_are_replaced_by_key(spark, tmp_path):
    path, ddl = str(tmp_path / "export"), "cohortId long, startDay date, someText string"
    first = literal_frame(spark, [(1, None, "a,b"), (2, None, "c")], ddl)
    save_incremental(first, path, ["cohortId"])
    for _ in range(2):
        save_incremental(literal_frame(spark, [(2, None, "d"), (3, None, None)], ddl), path, ["cohortId"])
        stored = read_csv(spark, path, struct_type(ddl))
        assert plain(stored, "cohortId", "someText") == [(1, "a,b"), (2, "d"), (3, None)]
    assert spark.read.option("header", True).csv(path).columns == ["cohort_id", "start_day", "some_text"]


def test_one_call_empties_the_work_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(durable, "work_dir", lambda _: str(tmp_path))
    spark.range(3).write.parquet(durable.new_folder(spark, "results"))
    durable.durable(spark.range(3))
    durable.clear_work_dir(spark)
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith(".")]


def test_results_are_built_once_for_the_same_files_and_definition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reuse, "work_dir", lambda _: str(tmp_path / "work"))
    source = str(tmp_path / "in put")
    built = []

    def query(definition):
        def build():
            built.append(definition)
            return spark.read.parquet(source).selectExpr("count(*) AS n")

        return reuse.reused("n", [spark.read.parquet(source)], definition, build).collect()[0].n

    spark.range(5).write.parquet(source)
    assert [query({"a": 1}), query({"a": 1}), query({"a": 2})] == [5, 5, 5] and built == [{"a": 1}, {"a": 2}]
    spark.range(3).write.mode("append").parquet(source)
    assert query({"a": 1}) == 8 and len(built) == 3
    monkeypatch.setattr(reuse, "_code", lambda: "other")
    assert query({"a": 1}) == 8 and len(built) == 4
    assert reuse.forget(spark, older_than_days=1) == [] and len(reuse.forget(spark)) == 4
    assert query({"a": 1}) == 8 and len(built) == 5


def test_a_result_that_was_never_finished_is_built_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reuse, "work_dir", lambda _: str(tmp_path / "work"))
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    frame = spark.read.parquet(source)
    broken = frame.select(F.raise_error(F.lit("broken")).cast("int").alias("n"))
    with pytest.raises(Exception, match="broken"):
        reuse.reused("n", [frame], "d", lambda: broken).collect()
    assert reuse.reused("n", [frame], "d", lambda: frame).count() == 5


def test_merged_sites_are_merged_again_when_a_file_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reuse, "work_dir", lambda _: str(tmp_path / "work"))
    (tmp_path / "a.csv").write_text('id,text\n1,"x\ny"\n')
    assert merged_sites(spark, str(tmp_path), TEXTS).count() == 1
    (tmp_path / "b.csv").write_text("id,text\n2,z\n")
    assert plain(merged_sites(spark, str(tmp_path), TEXTS), "id") == [(1,), (2,)]
