"""The supplied star schema read as clinical tables, for Spark and as DuckDB CTEs.

Both sides state the same mapping: customers are persons, orders are conditions and visits,
line items are measurements, parts and brands are concepts, regions are sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanrate.functions.dates import plus_days
from spanrate.sources.clinical import ClinicalTables
from spanrate.sources.durable import use_work_dir

BRAND_BASE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local"):
        # On one machine every folder is shared; on a cluster the session must name one.
        use_work_dir(spark, spark.conf.get("spark.sql.warehouse.dir") + "/_work")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_VIEWS: dict[tuple[SparkSession, str], ClinicalTables] = {}


def clinical(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    """The views of one folder; unevaluated plans, built once per session."""
    if (spark, sf_dir) not in _VIEWS:
        _VIEWS[spark, sf_dir] = _views(spark, sf_dir)
    return _VIEWS[spark, sf_dir]


def _views(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    orders = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    person = customer.select(
        key.alias("person_id"),
        F.when(key % 2 == 0, 8507).otherwise(8532).cast("long").alias("gender_concept_id"),
        (F.lit(1905) + (key * 7) % 90).cast("int").alias("year_of_birth"),
    )
    period = orders.groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.min(day).alias("observation_period_start_date"),
        F.max(day).alias("observation_period_end_date"),
    )
    period = period.select(
        F.col("person_id").alias("observation_period_id"),
        "person_id",
        "observation_period_start_date",
        "observation_period_end_date",
    )
    order = F.col("o_orderkey")
    condition = orders.select(
        order.alias("condition_occurrence_id"),
        F.col("o_custkey").alias("person_id"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("condition_concept_id"),
        day.alias("condition_start_date"),
        F.when(order % 5 != 0, plus_days(day, order % 10)).alias("condition_end_date"),
        order.alias("visit_occurrence_id"),
    )
    status = F.col("o_orderstatus")
    visit = orders.select(
        order.alias("visit_occurrence_id"),
        F.col("o_custkey").alias("person_id"),
        F.when(status == "F", 9201)
        .when(status == "O", 9203)
        .otherwise(262)
        .cast("long")
        .alias("visit_concept_id"),
        day.alias("visit_start_date"),
        plus_days(day, order % 14).alias("visit_end_date"),
    )
    line = table(spark, sf_dir, "lineitem")
    nth = F.row_number().over(
        W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    )
    flag = F.col("l_returnflag")
    measurement = (
        line.withColumn("_nth", nth)
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == order)
        .select(
            (F.col("l_orderkey") * 1000 + F.col("_nth")).alias("measurement_id"),
            F.col("o_custkey").alias("person_id"),
            F.col("l_partkey").alias("measurement_concept_id"),
            F.to_date("l_shipdate").alias("measurement_date"),
            F.col("l_quantity").cast("double").alias("value_as_number"),
            F.when(flag == "A", 1)
            .when(flag == "N", 2)
            .otherwise(3)
            .cast("long")
            .alias("value_as_concept_id"),
            F.when(F.col("l_linestatus") == "O", 1)
            .otherwise(2)
            .cast("long")
            .alias("unit_concept_id"),
            F.round(F.col("l_tax") * 1000, 0).alias("range_low"),
            F.col("l_orderkey").alias("visit_occurrence_id"),
        )
    )
    part = table(spark, sf_dir, "part")
    brand = (
        F.lit(BRAND_BASE) + F.regexp_extract("p_brand", r"#(\d+)", 1).cast("long")
    ).alias("concept_id")
    parts = part.select(
        F.col("p_partkey").alias("concept_id"),
        F.when(F.col("p_size") == 1, "D").alias("invalid_reason"),
    )
    brands = part.select(brand).distinct()
    visited = visit.select(F.col("visit_concept_id").alias("concept_id")).distinct()
    concept = parts.unionByName(brands.unionByName(visited), allowMissingColumns=True)
    ancestor = (
        part.select(
            brand.alias("ancestor_concept_id"), F.col("p_partkey").alias("descendant_concept_id")
        )
        .unionByName(
            concept.select(
                F.col("concept_id").alias("ancestor_concept_id"),
                F.col("concept_id").alias("descendant_concept_id"),
            )
        )
    )
    vocabulary = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("vocabulary_id"),
        F.concat(F.lit("v"), F.col("r_regionkey").cast("string")).alias("vocabulary_version"),
    )
    return ClinicalTables(
        person, period, condition, measurement, visit, concept, ancestor, vocabulary
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The tables the clinical views are made of, and the sites."""
    names = ("orders", "customer", "lineitem", "part", "region", "nation")
    return [table(spark, sf_dir, name) for name in names]


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, database_name): the region a customer lives in."""
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("subject_id"), F.col("r_name").alias("database_name"))
    )


CTES = {
    "person": """
  SELECT c_custkey AS person_id,
         CASE WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS gender_concept_id,
         1905 + (c_custkey * 7) % 90 AS year_of_birth
  FROM customer""",
    "op": """
  SELECT o_custkey AS person_id, MIN(CAST(o_orderdate AS DATE)) AS op_start,
         MAX(CAST(o_orderdate AS DATE)) AS op_end
  FROM orders GROUP BY o_custkey""",
    "cond": """
  SELECT o_orderkey AS id, o_custkey AS person_id,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS concept_id,
         CAST(o_orderdate AS DATE) AS s,
         COALESCE(CASE WHEN o_orderkey % 5 <> 0
                       THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 AS INTEGER) END,
                  CAST(o_orderdate AS DATE) + 1) AS e,
         o_orderkey AS visit_id
  FROM orders""",
    "vis": """
  SELECT o_orderkey AS id, o_custkey AS person_id,
         CASE o_orderstatus WHEN 'F' THEN 9201 WHEN 'O' THEN 9203 ELSE 262 END AS concept_id,
         CAST(o_orderdate AS DATE) AS s,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 14 AS INTEGER) AS e
  FROM orders""",
    "meas": """
  SELECT l_orderkey * 1000 + row_number() OVER (
           PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS id,
         o_custkey AS person_id, l_partkey AS concept_id, CAST(l_shipdate AS DATE) AS s,
         CAST(l_shipdate AS DATE) + 1 AS e, CAST(l_quantity AS DOUBLE) AS value_as_number,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS value_as_concept_id,
         CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS unit_concept_id,
         round(l_tax * 1000, 0) AS range_low, l_orderkey AS visit_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "concept": """
  SELECT p_partkey AS concept_id, CASE WHEN p_size = 1 THEN 'D' END AS invalid_reason FROM part
  UNION ALL
  SELECT DISTINCT 1000000 + CAST(substr(p_brand, 7) AS BIGINT), NULL FROM part
  UNION ALL
  SELECT DISTINCT concept_id, NULL FROM vis""",
    "ancestor": """
  SELECT 1000000 + CAST(substr(p_brand, 7) AS BIGINT) AS ancestor_id, p_partkey AS descendant_id
  FROM part
  UNION ALL SELECT concept_id, concept_id FROM concept""",
    "sites": """
  SELECT c_custkey AS subject_id, r_name AS database_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}
