from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " version string, dropped string, node string, score string, pos string"
)


@pytest.fixture(scope="session")
def words():
    draw = random.Random(5)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(400)]


@pytest.fixture()
def make_docs(spark):
    """A documents table with more columns, whose names the operators use inside."""

    def make(rows):
        full = [(i, t, lang, source, 0, "x", "x", "x", "x", "x") for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture()
def odd_rows(words):
    """Nulls, empty and very long texts, repeated rows and ids, ties."""
    draw = random.Random(11)
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    base = text(60)
    near = base.split()
    near[30] = "changed"
    shared = "This line is Shared by many documents"
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(near), "en", "b"),
        (3, " ".join(near), "en", "b"),
        (4, None, "en", "a"),
        (5, "", None, "b"),
        (6, " \n\t ", "de", None),
        (7, text(20_000), "en", "a"),
        (8, f"{shared}\n{text(30)}\n {shared.upper()}\t", "de", "a"),
        (9, f"{text(5)}\n{shared}", "de", None),
        (10, f"{shared}\n{shared}\n", "en", "c"),
        (None, f"{shared}\nno id", "en", "c"),
        (11, "one", "en", "c"),
        (12, "123 456 !!", None, "c"),
        (13, text(40), "en", "é"),
        (13, text(41), "en", "é"),
        (14, "Größe " * 30, "de", "𐀀"),
    ]
