"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrate.llm.bbit_minhash import near_duplicates
from spanrate.llm.cross_parsing import held_out, identify_languages, learnable
from spanrate.llm.feistel import pseudonyms
from spanrate.llm.kneser_ney import judge_quality
from spanrate.llm.line_bitmaps import line_bitmaps
from spanrate.llm.positional_index import contamination
from spanrate.llm.prefix_trie import conversation_prefixes, prefix_trie
from spanrate.llm.suffix_shards import repeated_spans
from spanrate.llm.systematic_mix import systematic_copies
from spanrate.llm.text import index_words, space_words, text_key
from spanrate.llm.token_alignment import align_tokens
from spanrate.llm.token_transducer import count_tokens
from spanrate.llm.url_rules import UrlRule, judge_urls
from spanrate.llm.warc_normaliser import archive_pages, read_records

TOKEN_LIMIT = 4096
URL_RULES = [
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
]
#: Stands for the secret that a deployment keeps elsewhere.
PSEUDONYM_KEY = b"key of the registered query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    counts = count_tokens(_table(spark, sf_dir, "documents"), model)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify_languages(docs, learnable(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = contamination(docs, _table(spark, sf_dir, "benchmark"))
    found = found.withColumnsRenamed({"doc": "__doc", "version": "__version"})
    rows = docs.select(
        "doc_id",
        text_key(F.col("text")).alias("__v"),
        F.size(index_words(F.col("text"))).cast("long").alias("n_words"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__v") == F.col("__version"))
    joined = rows.join(found, same, "left")
    ids = F.coalesce(F.array_join("item_ids", ","), F.lit(""))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = archive_pages(_table(spark, sf_dir, "pages"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read_records(index, folder, columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = systematic_copies(_table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return copies.select("doc_id", "size", "source_size", "target", taken)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_bitmaps(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    n = F.size("spans").cast("long")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("spans.kind"))), ",")
    return found.select("doc_id", "text", n.alias("n_found"), kinds.alias("kinds"), (n > 0).alias("has_pii"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(_table(spark, sf_dir, "documents"))
    kept = F.array_join(space_words(F.col("kept_text")), " ")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(conversation_prefixes(_table(spark, sf_dir, "conversations"), rebuild=True))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_tokens(_table(spark, sf_dir, "documents"), *paths)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_token_counts,
        op2_language_id,
        op3_decontamination,
        op4_warc,
        op5_near_duplicates,
        op6_url_filter,
        op7_mixing,
        op8_line_dedup,
        op9_pii,
        op10_quality,
        op11_substring_dedup,
        op12_prefix_trie,
        op13_token_alignment,
    ]
    return {f.__name__: f for f in found}
