"""Column expressions for words, lines and letter case that treat ASCII alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII strings take the engine's quick path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def space_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \x09-\x0D]+"), "")


def index_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and anything beyond ASCII; none for null."""
    breaks = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), breaks), "")


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id; equal rows share the key, and null is not empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def id_text(item_id: Column) -> Column:
    return F.coalesce(item_id.cast("string"), F.lit(""))


def set_apart(docs: DataFrame, **named: str) -> DataFrame:
    """``docs`` under the operator's own names (name=column), all other columns in one struct, ``row``.

    Whatever the others are called, nothing that is joined or added beside them clashes.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in named.values()]
    row = [F.struct(*rest).alias("row")] if rest else []
    return docs.select(*row, *[F.col(f"`{c}`").alias(name) for name, c in named.items()])


def put_back(rows: DataFrame, columns: list[str], *more: Column, **named: str) -> DataFrame:
    """The columns of before, in their order, then ``more``."""
    names = {c: name for name, c in named.items()}
    own = [F.col(names[c]) if c in names else F.col("row").getField(c) for c in columns]
    return rows.select(*[x.alias(c) for x, c in zip(own, columns, strict=True)], *more)
