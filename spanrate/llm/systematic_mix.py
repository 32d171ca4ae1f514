"""Mixing sources to target weights by systematic sampling.

Sources in code-point order, null last, take the weights in turn and share ``share`` of all words;
a target stops at ``cap`` times the source's words and the excess is shared out again by weight.
Every document of a source expects target / source words copies. Running sums of that, with one
offset per source, cross whole numbers; each crossing emits the document once.

Documents run in order of their size class (length and first four bits of the size), so that the
words taken stay near the target whatever the sizes. Ranks need no single task: rows are numbered
inside cells of (source, size class, hash bucket of the id), and running sums over the counts of
the cells, at most some thousands for a source, do the rest. Offsets and buckets come from MD5 of
names and ids, so reruns agree.

Null text has size 0. Documents of a source without words are never taken. Repeated rows are
documents of their own. Null ids sort first in their cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanrate.llm.text import id_text, put_back, set_apart, space_words, text_key
from spanrate.llm.work import keep

CELL = ["source_key", "bits", "lead", "bucket"]


def source_targets(
    sized: DataFrame, weights: tuple[int, ...], share: float, cap: float
) -> DataFrame:
    """(source_key, source_size, target): one row per source."""
    totals = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights))
    weighed = totals.withColumn("weight", weight)
    weighed = weighed.withColumns(
        {"bound": F.col("source_size") * cap, "all_words": F.sum("source_size").over(Window.partitionBy())}
    )
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), "source_key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("all_words") * share - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", left / F.sum("weight").over(rest))
    # The level rises while sources stop at their bound and falls after the first that does not.
    top = F.max("level").over(Window.partitionBy())
    target = F.least(F.col("bound"), F.col("weight") * top)
    return levels.select("source_key", "source_size", target.alias("target"))


def systematic_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """Per row: doc_id, version (key of the text), source_key, size, source_size, target, copies."""
    size = F.size(space_words(F.col(text_col))).cast("long")
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text_key(F.col(text_col)).alias("version"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("source_key"),
        size.alias("size"),
    )
    digits = F.bin("size")
    sized = keep(
        rows.withColumns(
            {
                "bits": F.char_length(digits),
                "lead": F.substring(digits, 1, 4),
                "bucket": F.substring(F.md5(id_text(F.col("doc_id"))), 1, 2),
            }
        ),
        "sizes",
    )
    targets = keep(source_targets(sized, weights, share, cap), "targets")
    running = Window.partitionBy("source_key").orderBy("bits", "lead", "bucket")
    cells = sized.groupBy(CELL).agg(F.count("*").alias("in_cell"))
    before = F.sum("in_cell").over(running) - F.col("in_cell")
    cells = cells.join(targets, "source_key").select(*CELL, "source_size", "target", before.alias("before"))
    in_cell = Window.partitionBy(CELL).orderBy("size", "doc_id", "version")
    ranked = sized.withColumn("n", F.row_number().over(in_cell)).join(cells, CELL)
    rank = (F.col("before") + F.col("n")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("source_key")))
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)
    crossed = F.floor(rank * rate + offset) - F.floor((rank - 1.0) * rate + offset)
    return ranked.select(
        "doc_id",
        "version",
        "source_key",
        "size",
        "source_size",
        "target",
        crossed.cast("long").alias("copies"),
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    copy_col: str = "copy_no",
    **options,
) -> DataFrame:
    """The mix itself: ``docs`` with a row per emitted copy, numbered from 1 in ``copy_col``.

    Rows equal in id, source and text are numbered among themselves, by their other columns, each
    with its own copies. A column named like ``copy_col`` gives way to it.
    """
    copies = systematic_copies(docs, id_col, text_col, source_col, **options)
    counts = keep(
        copies.groupBy("doc_id", "version", "source_key")
        .agg(F.array_sort(F.collect_list("copies")).alias("copies"))
        .select(
            F.col("doc_id").alias("__id"),
            F.col("version").alias("__version"),
            F.col("source_key").alias("__source"),
            F.col("copies").alias("__copies"),
        ),
        "copies",
    )
    names = {"id": id_col, "text": text_col, "source": source_col}
    columns = [c for c in docs.columns if c != copy_col]
    rows = set_apart(docs.select(*[F.col(f"`{c}`") for c in columns]), **names)
    source = F.col("source").cast("string")
    rows = rows.withColumns(
        {
            "__v": text_key(F.col("text")),
            "__s": F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)),
        }
    )
    same = (
        F.col("id").eqNullSafe(F.col("__id"))
        & (F.col("__v") == F.col("__version"))
        & (F.col("__s") == F.col("__source"))
    )
    single = rows.join(counts.where(F.size("__copies") == 1), same).withColumn("__n", F.lit(1))
    others = F.to_json("row") if "row" in rows.columns else F.lit("")
    among = Window.partitionBy("__id", "__version", "__source").orderBy(others)
    repeated = rows.join(keep(counts.where(F.size("__copies") > 1), "repeated"), same)
    repeated = repeated.withColumn("__n", F.row_number().over(among))
    emitted = F.get(F.col("__copies"), F.col("__n") - 1).cast("int")
    out = single.unionByName(repeated).withColumn("__c", emitted).where(F.col("__c") > 0)
    number = F.explode(F.sequence(F.lit(1), F.col("__c"))).alias(copy_col)
    return put_back(out, columns, number, **names)
