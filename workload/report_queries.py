"""Queries over ledgers, site merging, censoring, pooling and report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrate.operators import disclosure as X
from spanrate.operators import ledger as L
from spanrate.operators import network as N
from spanrate.operators import report as R
from spanrate.operators import statistics as S
from spanrate.operators.incidence import CELL, Settings, outcome_frame
from spanrate.operators.ranking import with_places
from spanrate.plans import network_report as NR
from spanrate.schemas import literal_frame
from spanrate.specs import Analysis

from . import definitions as D
from .clinical import sites, table
from .incidence_queries import rounded, summary_by_site

Query = Callable[[SparkSession, str], DataFrame]

SITE_NAMES = {"AFRICA": "SITE_AF", "MIDDLE EAST": "SITE_ME", "Urgent": "Index event"}
BLOCKED = X.site_subgroup_grid([(("ASIA", "EUROPE"), (71, 81, 91)), (("AMERICA",), (21, 22))])
FOLD = NR.Fold(204, 203, "Low", "Unspecified")
TARGET, COMPARATOR, TAR = 101, 102, 7
ADULTS = [10 * a + g for a in range(4, 9) for g in (1, 2)]
DATABASES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# Ledgers: documents are the tasks, their text is the definition.


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.checksum("text").alias("checksum"))


def earlier_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents have run; those of low quality with another text."""
    changed = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("*")))
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents"), "doc_id")
        .select("doc_id", L.checksum(changed).alias("checksum"))
    )


def ledger_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.required_tasks(tasks(spark, sf_dir), earlier_ledger(spark, sf_dir), ["doc_id"])


def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = earlier_ledger(spark, sf_dir).withColumn("time_stamp", F.lit("2020-01-01").cast("date"))
    done = L.required_tasks(tasks(spark, sf_dir), old, ["doc_id"])
    return L.record_tasks(old, done, ["doc_id"], F.lit("2020-02-01").cast("date"))


def keyed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes per source and language, with the labelled documents' figures put in place."""
    documents = table(spark, sf_dir, "documents")
    key = ["source", "lang"]
    before = documents.groupBy(*key).agg(F.sum("n_chars").alias("n_chars"))
    labelled = (
        documents.join(table(spark, sf_dir, "labels"), "doc_id")
        .where("toxic = 1")
        .groupBy(*key)
        .agg(F.sum("n_chars").alias("n_chars"), F.count("*").alias("n_toxic"))
    )
    return L.keyed_replace(before.withColumn("n_toxic", F.lit(None).cast("long")), labelled, key)


# Site files: the orders of a region are the rows of its file.


def site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .join(sites(spark, sf_dir), F.col("o_custkey") == F.col("subject_id"))
        .select(
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            "o_orderpriority",
            F.to_date("o_orderdate").alias("order_date"),
            F.col("database_name").alias(N.SITE_FILE),
        )
    )


def site_merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.first_file_wins(site_rows(spark, sf_dir), ["order_date", "o_orderpriority"])


def dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["o_custkey", "o_orderpriority"]
    return N.drop_duplicate_keys(site_rows(spark, sf_dir), key, ["order_date", "o_orderkey"])


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.duplicate_key_count(site_rows(spark, sf_dir), ["o_custkey", "o_orderpriority"])


TEXT_SPEC = [
    N.FieldSpec("order_id", "bigint", primary_key=True),
    N.FieldSpec("level", "int"),
    N.FieldSpec("price", "float", empty_is_na=False),
    N.FieldSpec("day", "date"),
    N.FieldSpec("status", "varchar(5)", empty_is_na=False),
    N.FieldSpec("note", "varchar(255)", optional=True),
]


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a site would send them: text, with gaps and wrong values."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.when(status == "P", F.col("o_orderpriority"))
        .otherwise(F.substring("o_orderpriority", 1, 1))
        .alias("level"),
        F.when(status != "F", F.floor("o_totalprice").cast("string")).alias("price"),
        F.when(status == "O", F.lit("unknown"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("day"),
        F.when(status != "O", status).alias("status"),
    )


def coerce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.coerce_types(N.check_columns(text_rows(spark, sf_dir), TEXT_SPEC), TEXT_SPEC)


def coercion_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.coercion_failures(text_rows(spark, sf_dir), TEXT_SPEC)


def fill_key_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.fill_key_nulls(coerce_types(spark, sf_dir), TEXT_SPEC)


def row_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.older_layout(text_rows(spark, sf_dir), "cohort").select("order_id", "metadata")


def append_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders, and others on days and priorities the finished ones lack."""
    rows = site_rows(spark, sf_dir).drop(N.SITE_FILE)
    finished = rows.where("o_orderstatus = 'F'")
    opened = rows.where("o_orderstatus <> 'F'").withColumn("is_open", F.lit(1))
    return N.append_new_rows(finished, opened, ["order_date", "o_orderpriority"])


def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways to settle shared keys, as row counts per status."""
    rows = site_rows(spark, sf_dir)
    existing, new = rows.where("o_orderstatus <> 'P'"), rows.where("o_orderstatus = 'P'")
    key = ["o_custkey", "o_orderpriority"]
    parts = []
    for overwrite, label in ((True, "replace"), (False, "keep")):
        kept, added = N.split_conflicts(existing, new, key, overwrite)
        both = kept.unionByName(added).withColumn("rule", F.lit(label))
        parts.append(both.groupBy("rule", "o_orderstatus").agg(F.count("*").alias("n_rows")))
    return parts[0].unionByName(parts[1])


# Censoring and labels.


def censor_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region x outcome decisions, one column per outcome id, from the region's orders."""
    status = F.col("o_orderstatus")
    level = F.substring("o_orderpriority", 1, 1).cast("long") + 199
    counted = (
        table(spark, sf_dir, "orders")
        .join(sites(spark, sf_dir), F.col("o_custkey") == F.col("subject_id"))
        .groupBy(F.col("database_name").alias("DB"), level.alias("outcome"))
        .agg(
            F.count_if(status == "F").alias("f"),
            F.count_if(status == "O").alias("o"),
            F.count_if(status == "P").alias("p"),
        )
    )
    decision = F.when(F.col("f") >= F.col("o"), "No Censorship").when(
        F.col("p") <= F.col("o"), "Blinded"
    )
    return counted.groupBy("DB").pivot("outcome", [201, 202, 203, 204]).agg(F.first(decision))


def censor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.censor_matrix(censor_sheet(spark, sf_dir))


def allowed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = X.censored_side(censor_matrix(spark, sf_dir))
    return free.select(
        F.col("DB").alias("database_name"), F.col("PHENOTYPE").cast("long").alias("outcome_id")
    )


def blocked_subgroups(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, BLOCKED, "database_name string, subgroup_cohort_definition_id long")


def censor_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.apply_censoring(
        summary_by_site(spark, sf_dir), allowed_outcomes(spark, sf_dir), blocked_subgroups(spark)
    ).select(*CELL, "num_outcomes")


def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.label_strata(summary_by_site(spark, sf_dir)).select(
        *CELL, "subgroup_name", "gender", "age_group"
    )


def recode_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recode(summary_by_site(spark, sf_dir), SITE_NAMES).select(
        *CELL, "target_name", "num_outcomes"
    )


def clean_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = NR.clean_results(
        summary_by_site(spark, sf_dir),
        SITE_NAMES,
        allowed_outcomes(spark, sf_dir).replace(SITE_NAMES, subset=["database_name"]),
        blocked_subgroups(spark).replace(SITE_NAMES, subset=["database_name"]),
        [FOLD],
    )
    return rounded(out).select(
        *CELL, "outcome_name", "gender", "age_group", "num_outcomes", "incidence_rate_p100py"
    )


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = R.label_strata(summary_by_site(spark, sf_dir))
    return R.target_vs_comparator(labelled, "Urgent", "Start of year")


def target_vs_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compared(spark, sf_dir)).select(
        *CELL, "age_group", "incidence_rate_p100py", "general_rate_p100py"
    )


def plot_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.plot_strata(compared(spark, sf_dir), TAR, D.STANDARD_SUBGROUPS))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and label checks of the four reference frames, stacked."""
    results = summary_by_site(spark, sf_dir)
    frames = {
        "subgroup": R.subgroup_reference(results).select(
            F.concat_ws(
                "|", "subgroup_cohort_definition_id", "sex_group", "age_low", "age_high", "age_group"
            ).alias("entry")
        ),
        "outcome": R.outcome_reference(results).select(
            F.concat_ws("|", "outcome_id", "outcome_name", "clean_window").alias("entry")
        ),
        "design": R.design_reference(results).select(
            F.concat_ws(
                "|",
                "target_name",
                "time_at_risk_id",
                "time_at_risk_start_offset",
                "time_at_risk_end_offset",
            ).alias("entry")
        ),
        "database": R.database_reference(results).select(
            F.concat_ws("|", "database_name", "db_name").alias("entry")
        ),
    }
    out = None
    for name, frame in frames.items():
        frame = frame.withColumn("reference", F.lit(name))
        out = frame if out is None else out.unionByName(frame)
    return out


# Statistics.


def recovered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    censored = X.min_cell(summary_by_site(spark, sf_dir))
    return rounded(S.recovered_events(censored)).select(
        *CELL, "small_cell", "rate_p100kpy", "uncensored_outcomes"
    )


def chosen(subgroups: range | list[int], targets: tuple[int, ...] = (TARGET, COMPARATOR)) -> Settings:
    """The part of the study that a report reads: nothing else is built."""
    outcomes = tuple(o.outcome_id for o in D.SETTINGS.outcomes)
    return D.SETTINGS.chosen_by(Analysis("report", targets, tuple(subgroups), (TAR,), outcomes))


POOLED = chosen(range(21, 100), (TARGET,))
STANDARDISED = chosen(ADULTS)


def pooled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    results = summary_by_site(spark, sf_dir, POOLED)
    return results, NR.meta_analysis(results, [TARGET], [TAR], [201, 202, 203, 204])


def pool_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates have fewer digits: their prediction limits may be very large."""
    estimates = pooled(spark, sf_dir)[1]
    rates = [c for c in estimates.columns if c.startswith("rate")]
    return rounded(estimates.withColumns({c: F.round(c, 2) for c in rates}))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = X.min_cell(summary_by_site(spark, sf_dir, STANDARDISED))
    return S.standardised_strata(results, [TARGET], [COMPARATOR], [TAR], ADULTS)


def standardised_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strata(spark, sf_dir))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exact_ratios(S.standardised_totals(strata(spark, sf_dir)))


def sir_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ratios(spark, sf_dir))


def pool_sir(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = X.min_cell(summary_by_site(spark, sf_dir, STANDARDISED))
    return rounded(NR.ratio_analysis(results, [TARGET], [COMPARATOR], [TAR], ADULTS)[1])


# Tables and plots.


def pivot_age_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, _ = NR.age_sex_table(*pooled(spark, sf_dir))
    return rounded(wide, 2)


def stack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stacked = NR.age_sex_table(*pooled(spark, sf_dir))
    return stacked


def pivot_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = summary_by_site(spark, sf_dir, POOLED)
    cells = S.recovered_events(results).where(
        (F.col("target_cohort_definition_id") == TARGET)
        & (F.col("time_at_risk_id") == TAR)
        & F.col("subgroup_cohort_definition_id").between(21, 99)
        & (F.col("num_persons_at_risk") > 0)
        & (F.col("person_years") > 0)
    )
    labelled = cells.join(
        R.subgroup_reference(results).drop("subgroup_name"), "subgroup_cohort_definition_id"
    ).join(R.database_reference(results), "database_name")
    return rounded(R.pivot_site(labelled, DATABASES, ["Male", "Female"], "rate_p100kpy"))


RATIO_COLUMNS = [
    "general_weighted_rate",
    "target_weighted_rate",
    "expected",
    "observed",
    "sir",
    "sir_lower",
    "sir_upper",
    "log_sir",
    "log_sir_se",
]


def with_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios and sentinel rows of censored outcomes, with the doubled ones removed."""
    hidden = X.censored_side(censor_matrix(spark, sf_dir), censored=True)
    names = D.SETTINGS.outcomes
    named = hidden.join(
        F.broadcast(outcome_frame(spark, names)).select(
            F.col("outcome_id").cast("string").alias("PHENOTYPE"), "outcome_name"
        ),
        "PHENOTYPE",
        "left",
    ).withColumnRenamed("DB", "database_name")
    rows = ratios(spark, sf_dir).select(
        "database_name", "time_at_risk_id", "outcome_name", *RATIO_COLUMNS
    )
    stacked = rows.unionByName(R.censored_rows(named, RATIO_COLUMNS, TAR))
    return R.drop_doubled_sentinels(stacked, "Medium")


def sentinel_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(with_sentinels(spark, sf_dir))


def forest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = R.forest_frame(with_sentinels(spark, sf_dir))
    return rounded(frame).select(
        "outcome_name", "name", "plot_rr", "plot_lower", "plot_upper", "label"
    )


def pooled_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = R.pooled_forest(S.pool_ratios(ratios(spark, sf_dir)))
    return rounded(frame).select(
        "outcome_name", "name", "plot_rr", "plot_lower", "plot_upper", "label"
    )


def ranked_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled_ratios = S.pool_ratios(ratios(spark, sf_dir)).withColumn(
        "outcome_name", F.concat(F.lit("[NC] "), "outcome_name", F.lit("?"))
    )
    cleaned = R.clean_names(pooled_ratios, "outcome_name", R.NAME_CLEANUP)
    ranked = with_places(cleaned, [F.col("sir").desc_nulls_last(), "outcome_name"])
    return ranked.select("outcome_name", F.round("sir", 6).alias("sir"), "num_studies", "place")


def ranked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every cell of all sites by outcomes, then persons at risk."""
    order = [F.desc("num_outcomes"), F.desc("num_persons_at_risk"), *CELL]
    ranked = with_places(summary_by_site(spark, sf_dir), order)
    return ranked.select(*CELL, "num_outcomes", "num_persons_at_risk", "place")


def pooled_site_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest frame of all sites with the pooled ratio as summary row."""
    own = ratios(spark, sf_dir)
    frame = R.forest_frame(own.select("database_name", "outcome_name", *RATIO_COLUMNS), S.pool_ratios(own))
    return rounded(frame).select("outcome_name", "name", "plot_rr", "plot_lower", "plot_upper", "label")


def queries() -> dict[str, Query]:
    return {
        "ledger_required": ledger_required,
        "ledger_upsert": ledger_upsert,
        "keyed_replace": keyed_replace,
        "site_merge_first_wins": site_merge_first_wins,
        "dedupe_key": dedupe_key,
        "duplicate_keys": duplicate_keys,
        "coerce_types": coerce_types,
        "coercion_failures": coercion_failures,
        "fill_key_nulls": fill_key_nulls,
        "row_to_json": row_to_json,
        "append_new_rows": append_new_rows,
        "key_conflicts": key_conflicts,
        "censor_matrix_unpivot": censor_matrix,
        "censor_apply": censor_apply,
        "label_parse": label_parse,
        "recode_values": recode_values,
        "clean_results": clean_results,
        "target_vs_comparator": target_vs_comparator,
        "plot_strata": plot_strata,
        "reference_frames": references,
        "recovered_events": recovered_events,
        "pool_rates": pool_rates,
        "standardised_rates": standardised_rates,
        "sir_exact": sir_exact,
        "pool_sir": pool_sir,
        "pivot_age_sex": pivot_age_sex,
        "stack_blocks": stack_blocks,
        "pivot_site": pivot_site,
        "sentinel_except": sentinel_except,
        "forest_frame": forest_frame,
        "pooled_forest": pooled_forest,
        "pooled_site_forest": pooled_site_forest,
        "ranked_ratios": ranked_ratios,
        "ranked_cells": ranked_cells,
    }
