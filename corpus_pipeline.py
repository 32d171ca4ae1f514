"""From raw documents to a training mix: five stages, each over all that the one before kept.

Language identification drops documents in no language, line dedup drops repeated lines, MinHash
keeps one document of each group of near copies, decontamination drops documents that hold a
benchmark passage, and the mix repeats or leaves out documents to meet the sources' targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrate.llm.bbit_minhash import drop_near_duplicates
from spanrate.llm.cross_parsing import drop_unidentified
from spanrate.llm.line_bitmaps import drop_lines
from spanrate.llm.positional_index import contamination
from spanrate.llm.systematic_mix import mixed_documents
from spanrate.llm.text import put_back, set_apart, text_key
from spanrate.llm.work import keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unidentified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one; ``n_chars`` follows the text."""
    shorter = drop_lines(docs)
    return shorter.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else shorter


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = keep(found.select("doc", "version"), "contaminated")
    names = {"doc_id": "doc_id", "text": "text"}
    rows = set_apart(docs, **names)
    same = F.col("doc_id").eqNullSafe(F.col("doc")) & (text_key(F.col("text")) == F.col("version"))
    return put_back(rows.join(hit, same, "left_anti"), docs.columns, **names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row per copy."""
    return mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL expresses neither the language model nor components of near copies at size; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
