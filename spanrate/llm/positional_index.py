"""Benchmark decontamination: a positional index of the training text, searched rarest term first.

``build_index`` stores the postings (document, position, term) of every training word that occurs
in the benchmark. For each window of an item (``window`` consecutive words; a shorter item is one
window) the two positions whose terms have the shortest posting lists are its anchors. Postings of
anchors, moved back by their offset in the item, give a diagonal (document, item, start); only
diagonals on which two lists meet go on. They are compared with the item word by word, so that
matches are exact; equal hashes of different words cost time and nothing else.

The terms of the benchmark are written first: the planner knows their size and broadcasts them
only under its own limit. Beyond it they are joined by term, and adaptive skew joins split common
terms.

Null or wordless texts have no words and no matches; a null item id counts as the empty string;
items that repeat an id are searched each and listed once. Rows that repeat an id and a text are
one document in the index and one result row each. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrate.llm.text import id_text, index_words, text_key
from spanrate.llm.work import keep

DOC = ["doc", "version"]


def item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, words): items with words, each text of an id once."""
    words = items.select(
        id_text(F.col(item_col)).alias("item_id"), index_words(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0)
    return words.distinct().select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, n_words, item_pos, term)."""
    return items.select(
        "item", F.size("words").alias("n_words"), F.posexplode("words").alias("item_pos", "word")
    ).select("item", "n_words", "item_pos", F.xxhash64("word").alias("term"))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored postings (doc, version, pos, term) of the words that are among ``terms``."""
    positions = docs.select(
        F.col(id_col).alias("doc"),
        text_key(F.col(text_col)).alias("version"),
        F.posexplode(index_words(F.col(text_col))).alias("pos", "word"),
    ).select("doc", "version", "pos", F.xxhash64("word").alias("term"))
    wanted = keep(terms.select("term").distinct(), "terms")
    return keep(positions.join(wanted, "term", "left_semi").select(*DOC, "pos", "term"), "postings")


def list_lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("n_postings"))


def rarest_positions(terms: DataFrame, lengths: DataFrame, window: int) -> DataFrame:
    """(item, item_pos, term, n_words): the two positions of every window with the shortest lists.

    A window with a term that has no postings occurs nowhere and needs no anchors.
    """
    sized = terms.join(lengths, "term", "left").fillna(0, ["n_postings"])
    last = F.greatest(F.col("n_words") - window, F.lit(0))
    starts = F.sequence(
        F.greatest(F.col("item_pos") - (window - 1), F.lit(0)), F.least(F.col("item_pos"), last)
    )
    in_windows = sized.withColumn("start", F.explode(starts))
    place = F.struct("n_postings", "item_pos", "term")
    chosen = (
        in_windows.groupBy("item", "n_words", "start")
        .agg(F.slice(F.array_sort(F.collect_list(place)), 1, 2).alias("anchors"))
        .where(F.col("anchors")[0]["n_postings"] > 0)
        .select("item", "n_words", F.explode("anchors").alias("a"))
    )
    return chosen.select("item", "n_words", F.col("a.item_pos"), F.col("a.term")).distinct()


def diagonals(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc, version, item, start): where the lists of two anchors of an item meet."""
    hits = postings.join(anchors, "term").select(
        *DOC, "item", (F.col("pos") - F.col("item_pos")).alias("start"), "item_pos", "n_words"
    )
    met = hits.groupBy(*DOC, "item", "start").agg(
        F.min("item_pos").alias("low"), F.max("item_pos").alias("high"), F.max("n_words").alias("n")
    )
    return met.where((F.col("low") < F.col("high")) | (F.col("n") == 1)).select(*DOC, "item", "start")


def _window_starts(own: Column, item: Column, window: int) -> Column:
    """Starts in the item of the windows that are equal in the document."""
    n = F.size(item)
    length = F.least(n, F.lit(window))
    return F.filter(
        F.sequence(F.lit(0), n - length),
        lambda s: F.slice(own, s + 1, length) == F.slice(item, s + 1, length),
    )


def _runs(starts: Column, length: Column) -> Column:
    """Sorted window starts as merged runs [first, end)."""
    empty = F.array().cast("array<struct<first:int,end:int>>")

    def add(done: Column, s: Column) -> Column:
        run = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s)
        longer = F.struct(run["first"].alias("first"), (s + length).alias("end"))
        fresh = F.struct(s.alias("first"), (s + length).alias("end"))
        return F.when(
            joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        ).otherwise(F.concat(done, F.array(fresh)))

    return F.aggregate(starts, empty, add)


def phrase_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """(doc, version, item_id, runs): runs [first, end) of document words inside exact windows."""
    found = keep(item_words(items, item_col, item_text_col), "items")
    terms = keep(item_terms(found), "item-terms")
    postings = build_index(docs, terms, id_col, text_col)
    lengths = keep(list_lengths(postings), "list-lengths")
    anchors = keep(rarest_positions(terms, lengths, window), "anchors")
    at = keep(
        diagonals(postings, anchors)
        .groupBy(*DOC)
        .agg(F.collect_list(F.struct("item", "start")).alias("at"))
        .withColumnsRenamed({"doc": "__doc", "version": "__version"}),
        "diagonals",
    )
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = rows.withColumn("version", text_key(F.col("text")))
    same = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("version") == F.col("__version"))
    rows = rows.join(at, same).select(*DOC, "at", index_words(F.col("text")).alias("own"))
    rows = rows.select(*DOC, F.explode("at").alias("d"), "own")
    # Only the stretch that faces the item leaves this stage. A diagonal may begin before the text.
    pad = F.greatest(-F.col("d.start"), F.lit(0))
    rows = rows.join(
        found.select("item", "item_id", F.col("words").alias("theirs")), F.col("d.item") == F.col("item")
    )
    facing = F.slice(
        "own", F.greatest(F.col("d.start"), F.lit(0)) + 1, F.greatest(F.size("theirs") - pad, F.lit(0))
    )
    rows = rows.select(
        *DOC,
        "item_id",
        F.col("d.start").alias("start"),
        F.concat(F.array_repeat(F.lit(""), pad), facing).alias("facing"),
        "theirs",
    )
    starts = _window_starts(F.col("facing"), F.col("theirs"), window)
    length = F.least(F.size("theirs"), F.lit(window))
    rows = rows.withColumn("starts", starts).where(F.size("starts") > 0)
    moved = F.transform("starts", lambda s: s + F.col("start"))
    return rows.select(*DOC, "item_id", _runs(moved, length).alias("runs"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """(doc, version, n_hit, item_ids): documents with a match; item ids sorted as strings."""
    matches = phrase_matches(docs, items, id_col, text_col, item_col, item_text_col, window)
    merged = matches.groupBy(*DOC).agg(
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def cover(done: Column, run: Column) -> Column:
        fresh = run["end"] - F.greatest(run["first"], done["upto"])
        return F.struct(
            F.greatest(done["upto"], run["end"]).alias("upto"),
            (done["n"] + F.greatest(fresh, F.lit(0)).cast("long")).alias("n"),
        )

    n_hit = F.aggregate("runs", start, cover, lambda done: done["n"])
    return merged.select(*DOC, n_hit.alias("n_hit"), "item_ids")


def proximity_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n_terms: int = 4,
    span: int = 30,
) -> DataFrame:
    """(doc, version, item_id, first, last): the n_terms rarest terms of an item, in any order,
    within ``span`` words; per document and item the earliest such stretch.

    Items with fewer different terms are searched with all they have.
    """
    found = keep(item_words(items, item_col, item_text_col), "items")
    terms = keep(item_terms(found), "item-terms")
    postings = build_index(docs, terms, id_col, text_col)
    lengths = keep(list_lengths(postings), "list-lengths")
    distinct = terms.select("item", "term").distinct().join(lengths, "term", "left").fillna(0)
    rare = distinct.groupBy("item").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("n_postings", "term"))), 1, n_terms).alias("rare")
    )
    rare = keep(
        rare.where(F.col("rare")[0]["n_postings"] > 0).select(
            "item", F.size("rare").alias("wanted"), F.explode("rare.term").alias("term")
        ),
        "rare-terms",
    )
    hits = postings.join(rare, "term")
    near = Window.partitionBy(*DOC, "item").orderBy("pos").rangeBetween(-(span - 1), 0)
    hits = hits.withColumns(
        {"seen": F.size(F.collect_set("term").over(near)), "first": F.min("pos").over(near)}
    )
    hits = hits.where(F.col("seen") == F.col("wanted"))
    best = hits.groupBy(*DOC, "item").agg(F.min(F.struct("pos", "first")).alias("at"))
    return best.join(found.select("item", "item_id"), "item").select(
        *DOC, "item_id", F.col("at.first").alias("first"), F.col("at.pos").alias("last")
    )
