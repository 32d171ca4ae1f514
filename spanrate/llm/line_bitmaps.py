"""Line dedup: range-partitioned line hashes and per-document keep bitmaps.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least
``min_chars`` code points that is found in at least ``min_docs`` documents loses all its lines
except those of the largest id that holds it.

Lines become 128-bit hashes, dealt by range over (hash, salt) and sorted by document and position
inside, so that one line held by a third of all documents still spreads over many tasks. The same
stage streams over the sorted rows and marks each document's first occurrence of a key; those are
counted per partition, then per hash. The result of a document is a bitmap of its kept lines as runs.

Repeated hashes meet the lines again by (hash, salt), under the salts that they have, and positions
meet their texts by document. Both grow with the corpus and are far larger in memory than as a file,
so neither is ever broadcast.

Null text is one empty line, like empty text. Rows that repeat an id and a text are one document
for the counts and give one result row each; an id with several texts counts once per key. Null
ids are one document that sorts below all others. Other columns are neither read nor returned by
``line_bitmaps``; ``drop_lines`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrate.llm.text import SPACES, ascii_lower, put_back, set_apart, text_key
from spanrate.llm.work import keep

SALTS = 64
LOWEST = -(2**63)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = docs.select(
        F.coalesce(F.col(id_col), F.lit(LOWEST)).alias("doc"),
        text_key(F.col(text_col)).alias("version"),
        F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"),
    )
    key = F.btrim(ascii_lower(F.col("line")), F.lit(SPACES))
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    dealt = (
        lines.where(F.char_length(F.btrim("line", F.lit(SPACES))) >= min_chars)
        .select("doc", "version", "pos", F.unhex(F.md5(key)).alias("key"), salt.alias("salt"))
        .repartitionByRange("key", "salt")
    )
    # Partitions by range hold every row of a (key, salt): the stream needs no other shuffle.
    stream = Window.partitionBy("key", "salt").orderBy(F.desc("doc"), "pos")
    return dealt.withColumn("first", F.coalesce(F.lag("doc").over(stream) != F.col("doc"), F.lit(True)))


def _repeated(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """Keys of enough documents, with the document that keeps them and a bit for each salt they have."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))
    return (
        occurrences.where("first")
        .groupBy("key")
        .agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"), F.bit_or(bit).alias("salts"))
        .where(F.col("n_docs") >= min_docs)
        .select("key", "keeper", "salts")
    )


def _salted(repeated: DataFrame) -> DataFrame:
    """(key, keeper, salt): a row per salt that the key has, so never more rows than occurrences."""
    had = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)
    return repeated.select("key", "keeper", F.explode(had).alias("salt"))


def dropped_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """(doc, version, dropped): sorted positions of the lines that go, for documents with any."""
    occurrences = keep(_occurrences(docs, id_col, text_col, min_chars), "lines")
    repeated = keep(_repeated(occurrences, min_docs), "repeated-lines")
    gone = occurrences.join(_salted(repeated).hint("merge"), ["key", "salt"]).where(F.col("doc") != F.col("keeper"))
    positions = F.array_sort(F.collect_set("pos")).alias("dropped")
    return keep(gone.groupBy("doc", "version").agg(positions), "dropped-lines")


def _keep_runs(dropped: Column, n_lines: Column) -> Column:
    """Runs (first, last) of kept lines between the dropped positions."""
    n = F.size(dropped)
    run = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(dropped, i - 1) + 1).alias("first"),
            F.when(i == n, n_lines - 1).otherwise(F.get(dropped, i) - 1).alias("last"),
        ),
    )
    return F.filter(run, lambda r: r["first"] <= r["last"])


def _with_runs(docs: DataFrame, id_col: str, text_col: str, dropped: DataFrame) -> DataFrame:
    """``docs`` with __lines, __n_dropped and __runs."""
    marks = dropped.select(
        F.col("doc").alias("__doc"), F.col("version").alias("__v"), F.col("dropped").alias("__gone")
    )
    rows = docs.withColumns(
        {
            "__d": F.coalesce(F.col(id_col), F.lit(LOWEST)),
            "__t": text_key(F.col(text_col)),
            "__none": F.array().cast("array<int>"),
        }
    )
    same = (F.col("__d") == F.col("__doc")) & (F.col("__t") == F.col("__v"))
    joined = rows.join(marks.hint("merge"), same, "left")
    joined = joined.withColumns(
        {"__lines": split_lines(F.col(text_col)), "__gone": F.coalesce("__gone", "__none")}
    )
    return joined.withColumns(
        {
            "__n_dropped": F.size("__gone"),
            "__runs": _keep_runs(F.col("__gone"), F.size("__lines")),
        }
    )


def _joined(runs: str, lines: str) -> Column:
    parts = F.transform(
        F.col(runs), lambda r: F.slice(F.col(lines), r["first"] + 1, r["last"] - r["first"] + 1)
    )
    return F.array_join(F.flatten(parts), "\n")


def line_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """Per row: the id, n_lines, n_dropped, keep_runs and kept_text (lazy: unused columns go)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dropped = dropped_lines(docs, "doc_id", "text", min_chars, min_docs)
    return _with_runs(docs, "doc_id", "text", dropped).select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        F.col("__n_dropped").cast("long").alias("n_dropped"),
        F.col("__runs").alias("keep_runs"),
        _joined("__runs", "__lines").alias("kept_text"),
    )


def drop_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """``docs`` with the text of the kept lines; untouched texts (null too) stay as they are."""
    names = {"doc_id": id_col, "text": text_col}
    rows = set_apart(docs, **names)
    dropped = dropped_lines(rows, "doc_id", "text", min_chars, min_docs)
    rows = _with_runs(rows, "doc_id", "text", dropped)
    text = F.when(F.col("__n_dropped") > 0, _joined("__runs", "__lines")).otherwise(F.col("text"))
    return put_back(rows.withColumn("text", text), docs.columns, **names)
