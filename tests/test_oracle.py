"""Registered queries against their SQL on the smallest data set, and the plans they run.

ORACLE_SF_DIR chooses the data.
"""

from __future__ import annotations

import os
from functools import cache
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import difference, duck
from spanrate.operators import cohort, events, incidence
from spanrate.operators.events import with_codes
from spanrate.plans import study
from spanrate.sources import durable as durable_module
from spanrate.sources import reuse
from workload import cohort_queries, incidence_queries, report_queries, site_queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
WRITERS = (cohort, events, incidence, study, cohort_queries)


def own_queries():
    modules = (cohort_queries, incidence_queries, report_queries, site_queries)
    return {name: query for m in modules for name, query in m.queries().items()}


NAMES = sorted(own_queries())


@pytest.fixture(scope="module")
def con():
    if not Path(SF_DIR).exists():
        pytest.skip(f"no data in {SF_DIR}")
    return duck(SF_DIR)


@pytest.fixture(scope="module")
def plans():
    """The plans of all tables written on the way, as they are planned.

    Summaries that several queries read are built once for the module.
    """
    seen = []

    def recorded(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return durable_module.durable(df)

    def built_once(name, inputs, definition, build):
        def build_recorded():
            df = build()
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return df

        return reuse.reused(name, inputs, definition, build_recorded)

    with pytest.MonkeyPatch.context() as patch:
        for module in WRITERS:
            patch.setattr(module, "durable", recorded)
        patch.setattr(incidence_queries, "reused", built_once)
        patch.setattr(incidence_queries, "study_cohorts", cache(incidence_queries.study_cohorts))
        kept = {}
        build = incidence_queries.summary_by_site

        def by_site(spark, sf_dir, settings=incidence_queries.D.SETTINGS):
            key = (sf_dir, id(settings))
            if key not in kept:
                kept[key] = build(spark, sf_dir, settings)
            return kept[key]

        for module in (incidence_queries, report_queries, site_queries):
            patch.setattr(module, "summary_by_site", by_site)
        yield seen


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_without_cross_joins(spark, con, plans, name):
    del plans[:]
    found = own_queries()[name](spark, SF_DIR)
    assert difference(found, con, entry.oracle_sql()[name]) is None
    for plan in [*plans, found._jdf.queryExecution().executedPlan().toString()]:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.queries()) & set(entry.oracle_sql())


def test_the_summary_shuffles_little(spark, con, plans):
    """Exchanges of all tables written for it and of its last plan."""
    del plans[:]
    incidence_queries.study_cohorts.cache_clear()
    last = incidence_queries.incidence_summary(spark, SF_DIR)
    text = "\n".join([*plans, last._jdf.queryExecution().executedPlan().toString()])
    assert text.count("Exchange hashpartitioning") < 60


def test_a_code_that_most_events_have_is_split(spark):
    scan = spark.range(10_000).select(
        (F.col("id") % 1000).alias("person_id"), F.when(F.col("id") % 10 > 0, 1).otherwise(2).alias("concept_id")
    )
    codes = spark.createDataFrame([(1,), (2,)], "concept_id int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = with_codes(scan, codes)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(sizes) == 10_000 and max(sizes) < 3_000


def test_many_codes_are_not_collected(spark, monkeypatch):
    """Their file is small, their rows are not: above the limit they are shuffled, salted."""
    scan = spark.range(10_000).select(
        (F.col("id") % 1000).alias("person_id"), F.when(F.col("id") % 10 > 0, 1).otherwise(2).alias("concept_id")
    )
    codes = durable_module.durable(spark.range(1, 301).select(F.col("id").cast("int").alias("concept_id")))
    few = with_codes(scan, codes)
    assert "_salt" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(events, "BROADCAST_CODES", 299)
    many = with_codes(scan, codes)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert many.count() == few.count() == 10_000
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
