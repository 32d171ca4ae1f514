"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrate.llm.work import keep


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to its least neighbour or itself."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select("v", "m")
    return moved.union(least.select("u", "m")).toDF("a", "b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, part) for every node of ``links`` (a, b); part is the least node of its component.

    Every round is written, so neither lineage nor driver memory grows; rounds end when the links
    no longer change, after about the logarithm of the longest chain.
    """
    edges = links.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    state = None
    while True:
        edges = keep(_small_star(_large_star(edges)), "edges")
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = edges.agg(F.count("*").alias("n"), mark.alias("mark")).first()
        if state == (now["n"], now["mark"]):
            break
        state = (now["n"], now["mark"])
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("part")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("part")).union(roots)
