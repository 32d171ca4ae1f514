"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed against it: the
longest stretch that occurs in the labelled text is a phrase, and the next begins behind it. The
language that needs the fewest phrases for the letters of the text wins; ties go to the smaller
name. The score is the margin: 1 - fewest / second fewest.

Text is compared as lower-cased UTF-8 bytes in which everything but letters is one space. It is
parsed in stretches of ``STRETCH`` bytes, all stretches of a batch in step, each byte of all of them
by one look into the automaton's table; a stretch border ends a phrase in every language alike.

The labelled text is a bounded sample, documented here: of every language the ``texts`` different
texts with the smallest hashes among the rows given, cut to ``train_bytes`` bytes in all, an equal
share from each. Nothing else is bounded; every text is parsed whole.

``drop_unidentified`` also rejects what reads like no learned language: a text with more than
``FACTOR`` times the phrases that a text of its size in its predicted language has, and ``SLACK`` more.
The phrases per byte of a language are the median over all different labelled texts that the automata
were not built from; a language with fewer than ``LEAST`` of those has no such bound. The whole corpus
is parsed once, and that parse gives both the medians and what is kept.

Null texts and texts without a letter are ``und`` with score 0, as are all texts if there is no
labelled text. With one language the score is 1. Repeated rows are predicted alike. Only id and
text are read for predictions.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrate.llm import textbytes
from spanrate.llm.text import put_back, set_apart, text_key
from spanrate.llm.work import keep, send_package

STRETCH = 512
UNKNOWN = "und"
#: Measured on sf0.1 against samples of like size: none of 6,386 learnable texts outside of the sample
#: goes; of 1,000 English texts with their letters shuffled 314 go at 40 characters, 855 at 100, 989
#: at 300 and all at 1,500; letters drawn evenly go at any of these sizes.
FACTOR = 2.0
SLACK = 3
LEAST = 20
#: Digits of phrases per byte: at most 10**DIGITS different values of a language are counted up.
DIGITS = 6


def normalised(text: Column) -> Column:
    """Lower-cased letters and marks, anything else one space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the states; every way from state 0 spells a stretch of ``text``."""
    after: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for byte in text:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and byte not in after[p]:
            after[p][byte] = new
            p = link[p]
        if p >= 0:
            q = after[p][byte]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(byte) == q:
                    after[p][byte] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return after


class Parser:
    """The automaton as a table: next state by state and byte class, 0 where a phrase ends."""

    def __init__(self, text: bytes):
        after = suffix_automaton(text)
        known = sorted({b for b in text})
        self.classes = np.zeros(256, np.intp)
        self.classes[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        table = np.zeros((len(after), self.width), np.int32)
        for state, ways in enumerate(after):
            for byte, to in ways.items():
                table[state, self.classes[byte]] = to * self.width
        self.table = table.ravel()

    def phrases(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each stretch; stretches come longest first."""
        count = np.zeros(len(starts), np.int64)
        state = np.zeros(len(starts), np.int32)
        codes = self.classes[data]
        live = len(starts)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[live - 1] <= step:
                live -= 1
            code = codes[starts[:live] + step]
            to = self.table[state[:live] + code]
            ended = np.flatnonzero(to == 0)
            # The byte that ends a phrase begins the next; unknown ones are phrases of their own.
            to[ended] = self.table[code[ended]]
            count[ended] += 1
            state[:live] = to
        return count + (sizes > 0)


@lru_cache(maxsize=2)
def parsers(samples: tuple[tuple[str, bytes], ...]) -> list[Parser]:
    return [Parser(text) for _, text in samples]


def count_phrases(samples, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[language, text] phrases."""
    sizes = np.diff(ends)
    per_text = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), per_text)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = ends[:-1][owner] + number * STRETCH
    lengths = np.minimum(STRETCH, ends[1:][owner] - starts)
    order = np.argsort(-lengths, kind="stable")
    found = np.zeros((len(samples), len(sizes)), np.int64)
    for row, parser in zip(found, parsers(samples), strict=True):
        phrases = parser.phrases(data, starts[order], lengths[order])
        np.add.at(row, owner[order], phrases)
    return found


def _labelled(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text, hash) of the rows that have a label and a letter."""
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return rows.withColumn("hash", text_key(F.col("text")))


def _numbered(rows: DataFrame) -> DataFrame:
    """(lang, hash, n): the different texts of each language in order of their hashes."""
    by_hash = Window.partitionBy("lang").orderBy("hash")
    return rows.select("lang", "hash").distinct().withColumn("n", F.row_number().over(by_hash))


def sample_keys(labelled: DataFrame, text_col: str, lang_col: str, texts: int) -> DataFrame:
    """(lang, hash) of the texts that the automata are built from."""
    rows = _labelled(labelled, text_col, lang_col)
    return keep(_numbered(rows).where(F.col("n") <= texts).drop("n"), "sample-keys")


def training_sample(
    labelled: DataFrame, chosen: DataFrame, text_col: str, lang_col: str, texts: int, train_bytes: int
) -> tuple[tuple[str, bytes], ...]:
    """(language, text) for every language, at most ``train_bytes`` bytes of each."""
    rows = _labelled(labelled, text_col, lang_col)
    # Bounded: at most ``texts`` rows of at most ``train_bytes`` characters for a language.
    share = max(1, train_bytes // texts)
    cut = F.substring(normalised(F.substring("text", 1, 4 * share)), 1, share)
    picked = rows.join(chosen, ["lang", "hash"]).groupBy("lang", "hash").agg(F.min(cut).alias("part"))
    gathered: dict[str, list[bytes]] = {}
    for row in picked.orderBy("lang", "hash").collect():
        gathered.setdefault(row["lang"], []).append(row["part"].strip().encode())
    return tuple((lang, b" ".join(parts)[:train_bytes]) for lang, parts in sorted(gathered.items()))


def phrase_limits(parsed: DataFrame, chosen: DataFrame) -> dict[str, float]:
    """Phrases per byte above which a text is in none of the languages, by predicted language.

    ``parsed`` (lang, hash, lang_pred, phrases, size) holds every labelled text that may be learned from.
    """
    rate = F.round(F.col("phrases") / F.col("size"), DIGITS)
    outside = parsed.join(chosen, ["lang", "hash"], "left_anti")
    different = outside.groupBy("lang", "hash").agg(F.min(F.struct("lang_pred", rate.alias("rate"))).alias("text"))
    counts = different.groupBy("text.lang_pred", "text.rate").agg(F.count("*").alias("n"))
    of_language = Window.partitionBy("lang_pred")
    placed = counts.withColumns(
        {
            "below": F.sum("n").over(of_language.orderBy("rate")),
            "all": F.sum("n").over(of_language),
        }
    )
    upper = placed.where((F.col("all") >= LEAST) & (2 * F.col("below") >= F.col("all")))
    medians = upper.groupBy("lang_pred").agg(F.min("rate").alias("rate"))
    return {r["lang_pred"]: FACTOR * r["rate"] for r in medians.collect()}


def _predictor(samples, carried: list[str], measures: bool):
    names = [name for name, _ in samples]

    def predict(batches):
        for block in textbytes.blocks(batches, "__text"):
            rows = block.num_rows
            data, ends = textbytes.utf8(block.column("__text"))
            fewest = np.zeros(rows, np.int64)
            if names:
                phrases = count_phrases(samples, data, ends)
                best = phrases.argmin(axis=0)
                ordered = np.sort(phrases, axis=0)
                fewest = ordered[0]
                score = 1.0 - fewest / np.maximum(ordered[1], 1) if len(names) > 1 else np.ones(rows)
                langs = [names[i] for i in best]
            else:
                langs, score = [UNKNOWN] * rows, np.zeros(rows)
            letters = block.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
            langs = np.where(letters, np.array(langs, object), UNKNOWN)
            score = np.where(letters, np.clip(score, 0.0, 1.0), 0.0)
            columns = [block.column(c) for c in carried]
            columns += [pa.array(langs, pa.string()), pa.array(score, pa.float64())]
            names_out = [*carried, "lang_pred", "score"]
            if measures:
                columns += [pa.array(fewest, pa.int64()), pa.array(np.diff(ends), pa.int64())]
                names_out += ["__phrases", "__size"]
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return predict


def predicted(
    docs: DataFrame, samples, text_col: str, columns: list[str] | None = None, measures: bool = False
) -> DataFrame:
    """``columns`` (or all) of ``docs`` with lang_pred and score, which replace columns so named.

    ``measures`` adds the fewest phrases and the bytes that were parsed.
    """
    send_package(docs.sparkSession)
    carried = [c for c in columns or docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType(
        [f for f in docs.schema.fields if f.name in carried]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
        + [T.StructField(name, T.LongType()) for name in ("__phrases", "__size") if measures]
    )
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*carried, letters.alias("__letters"), normalised(F.col(text_col)).alias("__text"))
    return rows.mapInArrow(_predictor(samples, carried, measures), schema)


def identify_languages(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    texts: int = 64,
    train_bytes: int = 32_768,
) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``, learned from the rows of ``labelled``."""
    chosen = sample_keys(labelled, text_col, lang_col, texts)
    samples = training_sample(labelled, chosen, text_col, lang_col, texts, train_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predicted(rows, samples, "text", ["doc_id"])


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: two thirds by the checksum of the id."""
    return docs.where(~held_out(F.col(id_col)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_unidentified(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    texts: int = 64,
    train_bytes: int = 32_768,
) -> DataFrame:
    """``docs`` without the rows in no language: no text, no letter, or too many phrases for any.

    Without labelled text nothing tells languages, and only rows without a letter go.
    """
    known = learnable(docs, id_col)
    chosen = sample_keys(known, text_col, lang_col, texts)
    samples = training_sample(known, chosen, text_col, lang_col, texts, train_bytes)
    if not samples:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    rows = set_apart(docs, text=text_col).withColumns(
        {
            "lang": F.when(~held_out(F.col("row").getField(id_col)), F.col("row").getField(lang_col)),
            "hash": text_key(F.col("text")),
        }
    )
    found = predicted(rows, samples, "text", measures=True).where(F.col("lang_pred") != UNKNOWN)
    found = keep(found, "parsed")
    measured = found.where(F.col("lang").isNotNull()).select(
        "lang", "hash", "lang_pred", F.col("__phrases").alias("phrases"), F.col("__size").alias("size")
    )
    limits = phrase_limits(measured, chosen)
    for lang, limit in sorted(limits.items()):
        most = limit * F.col("__size") + SLACK
        found = found.where((F.col("lang_pred") != lang) | (F.col("__phrases") <= most))
    return put_back(found, docs.columns, text=text_col)
