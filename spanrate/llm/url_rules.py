"""URL filters: association rules mined from labelled URLs, matched through an inverted index.

A URL becomes a set of tokens: its host's domain suffixes and first label, the words of its path,
its scheme and the names of its query parameters. URLs with a known verdict are the labels: the
verdict joins the tokens as one more item, FP-growth finds the frequent sets, and the rules that
conclude a verdict are kept if their support and confidence suffice and no rule with one token less
and the same verdict is as confident (pruning). Tokens of exactly the same labelled URLs are one item
while rules are mined, and any of them meets it: the rules are the same, and a URL of many words that
no other has costs one item. To judge a URL, its distinct tokens meet the rules' tokens
in an inverted index; a rule fires when all its tokens were met. The most confident rule that
fires decides, then the one with more support, then ``block``; without any the verdict is allow.

Judging groups the distinct token sets, not the rows, so that one host with a third of all pages
costs its distinct sets only.

Null URLs and those without ``://`` have an empty host, path and token set and are allowed.
Repeated rows are judged alike. Without labelled URLs there are no rules. Only the id and url
columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrate.llm.text import LOWER, UPPER
from spanrate.llm.work import keep

VERDICT = "verdict="
#: Labels that a domain name can have; of a longer host the last ones are its suffixes.
MOST_LABELS = 127


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = (host == rule.host) | host.endswith("." + rule.host)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits & path.startswith(rule.path), value).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL: scheme, domain suffixes, first label, path words, query names."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(MOST_LABELS))),
        lambda k: F.concat(F.lit("domain="), F.array_join(F.slice(labels, n - k + 1, k), ".")),
    )
    first = F.array(F.concat(F.lit("first="), labels[0]))
    words = F.array_remove(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), "")
    # Numbers name single pages; their presence is the token.
    words = F.transform(
        words, lambda w: F.concat(F.lit("path="), F.when(w.rlike(r"^\p{N}+$"), "0").otherwise(w))
    )
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(
        F.array_remove(F.split(query, "&"), ""),
        lambda q: F.concat(F.lit("query="), F.substring_index(q, "=", 1)),
    )
    scheme = F.array(F.concat(F.lit("scheme="), F.substring_index(url, "://", 1)))
    tokens = F.concat(scheme, suffixes, first, words, keys)
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.array_sort(F.array_distinct(tokens)))


def token_classes(sets: DataFrame, least: Column) -> DataFrame:
    """(token, item): tokens of ``least`` labelled rows or more; those with equal rows share an item.

    Equal rows are told by their number and two sums of the hashes of the sets (set_id, tokens, n).
    """
    held = sets.select("set_id", "n", F.explode("tokens").alias("token"))
    wide = lambda h: F.sum(h.cast("decimal(38,0)") * F.col("n"))
    same = held.groupBy("token").agg(
        F.sum("n").alias("rows"),
        wide(F.col("set_id")).alias("first"),
        wide(F.xxhash64(F.lit(2), "set_id")).alias("second"),
    )
    same = same.where(F.col("rows") >= least)
    item = F.min("token").over(Window.partitionBy("rows", "first", "second"))
    return same.select("token", item.alias("item"))


def mine_rules(
    labelled: DataFrame, min_support: float, min_confidence: float
) -> DataFrame:
    """(rule_id, parts, verdict, confidence, support) from (tokens, verdict) rows.

    Tokens that the labelled rows only ever hold together are one item, so that a long path is one
    item and not all the subsets of its words. ``parts`` lists, for each item of a rule, its
    tokens: a rule stands for all the rules that take one token of every part.
    """
    sets = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    sets = keep(sets.withColumn("set_id", F.xxhash64("tokens", "verdict")), "labelled-sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    classes = keep(token_classes(sets, F.lit(min_support * total)), "token-classes")
    items = (
        sets.select("set_id", F.explode("tokens").alias("token"))
        .join(classes, "token")
        .groupBy("set_id")
        .agg(F.collect_set("item").alias("items"))
    )
    none = F.array().cast("array<string>")
    baskets = sets.join(items, "set_id", "left").select(
        F.concat(F.coalesce("items", none), F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("n"))),
    )
    baskets = baskets.select("items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    mined = model.associationRules.where(
        F.col("consequent")[0].startswith(VERDICT)
    ).select(
        F.array_sort("antecedent").alias("items"),
        F.substring(F.col("consequent")[0], len(VERDICT) + 1, 1_000).alias("verdict"),
        "confidence",
        "support",
    )
    mined = keep(mined, "mined-rules")
    # A rule is redundant if one of its items can go and the shorter rule is as confident.
    place = F.explode(F.sequence(F.lit(0), F.size("items") - 1)).alias("i")
    shorter = mined.where(F.size("items") > 1).select("items", "verdict", "confidence", place)
    rest = F.filter("items", lambda _, i: i != F.col("i"))
    shorter = shorter.select(
        rest.alias("part"), "verdict", F.col("items").alias("whole"), F.col("confidence").alias("c")
    )
    known = mined.select(F.col("items").alias("part"), "verdict", "confidence")
    redundant = (
        shorter.join(known, ["part", "verdict"])
        .where(F.col("confidence") >= F.col("c"))
        .select(F.col("whole").alias("items"), "verdict")
        .distinct()
    )
    kept = mined.join(redundant, ["items", "verdict"], "left_anti")
    kept = kept.withColumn("rule_id", F.xxhash64("items", "verdict"))
    members = classes.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("part"))
    parts = (
        kept.select("rule_id", F.explode("items").alias("item"))
        .join(members, "item")
        .groupBy("rule_id")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
    )
    return kept.drop("items").join(parts, "rule_id")


def judge_tokens(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict): the verdict of every distinct set on which a rule fires."""
    postings = rules.select(
        "rule_id",
        F.size("parts").alias("needed"),
        "verdict",
        "confidence",
        "support",
        F.posexplode("parts").alias("place", "part"),
    )
    postings = keep(postings.withColumn("token", F.explode("part")).drop("part"), "rule-postings")
    sets = token_sets.select(F.xxhash64("tokens").alias("set_id"), "tokens").distinct()
    met = (
        sets.select("set_id", F.explode("tokens").alias("token"))
        .join(postings, "token")
        .groupBy("set_id", "rule_id", "place")
        .agg(
            F.max(F.struct("confidence", "support", F.col("verdict") == "block", "verdict")).alias("r"),
            F.max("needed").alias("needed"),
        )
        .groupBy("set_id", "rule_id")
        .agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("needed").alias("needed"))
        .where(F.col("n") == F.col("needed"))
    )
    best = met.groupBy("set_id").agg(F.max("r").alias("r"))
    return best.select("set_id", F.col("r.verdict").alias("verdict"))


def judge_urls(
    pages: DataFrame,
    rules: list[UrlRule],
    id_col: str = "page_id",
    url_col: str = "url",
    min_support: float = 0.01,
    min_confidence: float = 0.8,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": url_host(url), "path": url_path(url)})
    rows = rows.withColumns(
        {
            "listed": listed_rule(F.col("host"), F.col("path"), rules),
            "tokens": url_tokens(url, F.col("host"), F.col("path")),
        }
    ).drop("url")
    labelled = rows.where(F.col("listed").isNotNull()).select("tokens", F.col("listed.verdict").alias("verdict"))
    mined = keep(mine_rules(labelled, min_support, min_confidence), "url-rules")
    unlisted = rows.where(F.col("listed").isNull() & (F.size("tokens") > 0))
    judged = keep(judge_tokens(unlisted, mined), "token-verdicts")
    judged = judged.withColumnRenamed("verdict", "mined")
    rows = rows.withColumn("set_id", F.xxhash64("tokens")).join(judged, "set_id", "left")
    verdict = F.coalesce(F.col("listed.verdict"), F.col("mined"), F.lit("allow"))
    return rows.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict")
    )
