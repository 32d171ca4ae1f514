"""Substring dedup: suffix automata over shards of repeated passages give matching statistics.

A window is ``width`` consecutive words (anything but ASCII white space, compared unchanged) of one
document. A word goes if a window covers it whose word sequence also starts earlier: in a document
with a smaller id, or earlier in the same one. Windows are judged on the input, and the windows that
go merge into maximal spans.

Every automaton against every document would be work that grows with the square of the corpus, so
passages find their shard by content. The anchor of a window is its leftmost least run of ``anchor``
words by hash; equal windows have equal anchors wherever they stand. Neighbouring windows with one
anchor form a passage of at most ``2 * width - anchor`` words, and a document is the sequence of its
passages. Passages whose anchor occurs once in the corpus cannot repeat and stop there. Of the rest,
every different passage goes once, with its first place, to the shard of its anchor. A shard's
automaton is built over its passages in order of place and remembers for every state where it first
ended; streaming a passage through it gives the longest match at every word, and where the match of
``width`` words first began. All places of a passage are then judged by that.

Shards are dealt by anchor and hold about ``SHARD_WORDS`` words. An anchor with more than
``HOT_PASSAGES`` different passages is no shard: its windows find their first place by their own
hash, by an aggregate that combines before the shuffle. Words are compared as 64-bit hashes. Results
do not depend on these figures.

Null and empty texts have no words. Rows that repeat an id with another text are documents of their
own, ordered by the hash of the text; rows equal in id and text are one document and give equal
results. A null id sorts below all others. A text shorter than a window keeps its words. Only id and
text are read; ``drop_repeats`` keeps all other columns, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrate.llm import textbytes
from spanrate.llm.text import text_key
from spanrate.llm.work import discard, keep, send_package

#: Words of the different passages in a shard, about; its automaton takes some 600 bytes a word.
SHARD_WORDS = 100_000
#: Different passages of one anchor, beyond which its windows are looked up one by one.
HOT_PASSAGES = 1_000
#: Windows handled at once; a longer text is cut into runs of so many.
SEGMENT = 1 << 18
LOWEST = -(2**63)

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    grown = np.full(n, base, np.uint64)
    grown[0] = 1
    return np.multiply.accumulate(grown)


class RunHashes:
    """Hashes of any runs of words from one pass: differences of a running polynomial."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(words * _powers(_ODD, n)[1:], out=self.sums[1:])
        self.back = _powers(_INVERSE, n)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        value = (self.sums[stop] - self.sums[start]) * self.back[start]
        return textbytes.mixed(value + (stop - start).astype(np.uint64))


def _leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """Where the least of every ``span`` neighbours stands; of equal ones the first."""
    least, at, have = values, np.arange(len(values)), 1
    while have < span:
        step = min(have, span - have)
        right, right_at = least[step:], at[step:]
        left, left_at = least[: len(right)], at[: len(right)]
        other = right < left
        least, at = np.where(other, right, left), np.where(other, right_at, left_at)
        have += step
    return at


def passages(words: np.ndarray, offsets: np.ndarray, width: int, anchor: int):
    """(text, first window, number of windows, anchor hash, passage hash) of all texts' passages."""
    parts = []
    last_start = np.repeat(offsets[1:] - width, np.diff(offsets))
    for low in range(0, max(len(words) - width + 1, 0), SEGMENT):
        piece = words[low : low + SEGMENT + width - 1]
        n = len(piece) - width + 1
        valid = np.arange(low, low + n) <= last_start[low : low + n]
        if not valid.any():
            continue
        hashes = RunHashes(piece)
        grams = np.arange(len(piece) - anchor + 1)
        values = hashes.of(grams, grams + anchor)
        at = _leftmost_least(values, width - anchor + 1)[:n]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        first = np.flatnonzero(begins)
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
        n_windows = np.flatnonzero(ends) - first + 1
        key = hashes.of(first, first + n_windows + width - 1)
        text = np.searchsorted(offsets, first + low, "right") - 1
        parts.append((text, first + low - offsets[text], n_windows, values[at[first]], key))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


class PassageAutomaton:
    """A suffix automaton over several sequences; states know where they first ended."""

    def __init__(self):
        self.after: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.first: list[tuple[int, int]] = [(-1, -1)]

    def _state(self, ways: dict[int, int], length: int, link: int, first: tuple[int, int]) -> int:
        self.after.append(ways)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.after) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the longest suffix of ``q`` that ``p`` and ``word`` spell."""
        after, link = self.after, self.link
        copy = self._state(dict(after[q]), self.length[p] + 1, link[q], self.first[q])
        link[q] = copy
        while p >= 0 and after[p].get(word) == q:
            after[p][word] = copy
            p = link[p]
        return copy

    def add(self, number: int, words: list[int]) -> None:
        """Add a sequence; numbers grow from call to call."""
        after, link, length = self.after, self.link, self.length
        last = 0
        for at, word in enumerate(words):
            q = after[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                continue
            new = self._state({}, length[last] + 1, 0, (number, at))
            p = last
            while p >= 0 and word not in after[p]:
                after[p][word] = new
                p = link[p]
            if p >= 0:
                q = after[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = new

    def matches(self, words: list[int], width: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """Matching statistics: per word the longest match that ends there, of ``width`` words at
        most, and the (number, place) where that match first ended."""
        after, link, length, first = self.after, self.link, self.length, self.first
        state = size = 0
        for word in words:
            to = after[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = after[state].get(word)
            if to is None:
                yield 0, first[0]
                continue
            state, size = to, size + 1
            if size >= width:
                while length[link[state]] >= width:
                    state = link[state]
                size = width
            yield size, first[state]


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col), F.lit(LOWEST)).alias("doc")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        _id(id_col), text_key(F.col(text_col)).alias("version"), F.col(text_col).alias("text")
    )


def _each_block(batches: Iterator[pa.RecordBatch], width: int, anchor: int):
    for block in textbytes.blocks(batches, "text"):
        data, ends = textbytes.utf8(block.column("text"))
        words, _, _, offsets = textbytes.word_hashes(data, ends, False)
        yield block, words, passages(words, offsets, width, anchor)


def _anchor_counts(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    def run(batches):
        for _, _, found in _each_block(batches, width, anchor):
            anchors, n = np.unique(found[3].view(np.int64), return_counts=True)
            yield pa.record_batch([anchors, n], names=["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long")


def _places(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """(doc, version, start, n, anchor, passage) of all passages."""

    def run(batches):
        for block, _, (text, start, n, anchors, key) in _each_block(batches, width, anchor):
            rows = pa.array(text)
            yield pa.record_batch(
                [
                    block.column("doc").take(rows),
                    block.column("version").take(rows),
                    pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(anchors.view(np.int64)),
                    pa.array(key.view(np.int64)),
                ],
                names=["doc", "version", "start", "n", "anchor", "passage"],
            )

    return docs.mapInArrow(run, "doc long, version long, start int, n int, anchor long, passage long")


def _passage_words(docs: DataFrame, firsts: DataFrame, width: int) -> DataFrame:
    """The words, as hashes, of the passages in ``firsts``, read where each first stands."""
    asked = firsts.groupBy("doc", "version").agg(
        F.collect_list(F.struct("start", "n", "anchor", "passage")).alias("asked")
    )

    def run(batches):
        for block in textbytes.blocks(batches, "text"):
            data, ends = textbytes.utf8(block.column("text"))
            words, _, _, offsets = textbytes.word_hashes(data, ends, False)
            asked = block.column("asked")
            owner = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            start = flat.field("start").to_numpy()
            size = flat.field("n").to_numpy().astype(np.int64) + width - 1
            begins = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(begins[-1]) + np.repeat(offsets[owner] + start - begins[:-1], size)
            rows = pa.array(owner)
            yield pa.record_batch(
                [
                    flat.field("anchor"),
                    flat.field("passage"),
                    block.column("doc").take(rows),
                    block.column("version").take(rows),
                    flat.field("start"),
                    pa.ListArray.from_arrays(
                        pa.array(begins.astype(np.int32)), pa.array(words[at].view(np.int64))
                    ),
                ],
                names=["anchor", "passage", "doc", "version", "start", "words"],
            )

    found = docs.join(asked, ["doc", "version"]).select("doc", "version", "text", "asked")
    return found.mapInArrow(
        run, "anchor long, passage long, doc long, version long, start int, words array<long>"
    )


def _by_automata(units: DataFrame, n_shards: int, width: int) -> DataFrame:
    """(anchor, passage, gone): the windows of a passage's first place that start earlier."""

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc", "version", "start", "anchor", "passage")])
        automaton = PassageAutomaton()
        sequences = []
        known = set()
        keys = zip(table["anchor"].to_pylist(), table["passage"].to_pylist(), strict=True)
        for key, words in zip(keys, table["words"].to_pylist(), strict=True):
            if key not in known:  # rows equal in id and text bring a passage several times
                known.add(key)
                automaton.add(len(sequences), words)
                sequences.append((key, words))
        found = []
        for number, (key, words) in enumerate(sequences):
            gone = [
                at - width + 1
                for at, (size, first) in enumerate(automaton.matches(words, width))
                if size == width and first != (number, at)
            ]
            if gone:
                found.append((*key, gone))
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table(
            {
                "anchor": pa.array(columns[0], pa.int64()),
                "passage": pa.array(columns[1], pa.int64()),
                "gone": pa.array(columns[2], pa.list_(pa.int32())),
            }
        )

    dealt = units.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)))
    return dealt.groupBy("shard").applyInArrow(shard, "anchor long, passage long, gone array<int>")


def _by_window(units: DataFrame, width: int) -> DataFrame:
    """The same for anchors with very many passages, each window by its own hash."""
    window = F.xxhash64(F.slice("words", F.col("at") + 1, F.lit(width)), F.lit(1))
    other = F.hash(F.slice("words", F.col("at") + 1, F.lit(width)))
    last = F.size("words") - width
    rows = units.withColumn("at", F.explode(F.sequence(F.lit(0), last))).select(
        "anchor",
        "passage",
        "at",
        F.struct(window, other).alias("window"),
        F.struct("doc", "version", (F.col("start") + F.col("at")).alias("start")).alias("place"),
    )
    first = rows.groupBy("window").agg(F.min("place").alias("first"))
    later = rows.join(first, "window").where(F.col("place") != F.col("first"))
    return later.groupBy("anchor", "passage").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, anchor: int = 8
) -> DataFrame:
    """(doc, version, windows): per document with any, runs (first, last) of windows that go."""
    send_package(docs.sparkSession)
    docs = _documents(docs, id_col, text_col)
    counts = _anchor_counts(docs, width, anchor).groupBy("anchor").agg(F.sum("n").alias("n"))
    # Tables of their own: a join of plain shuffles splits a hot anchor, one with an aggregate does not.
    repeated = keep(counts.where("n > 1").select("anchor"), "repeated-anchors")
    places = keep(_places(docs, width, anchor).join(repeated, "anchor"), "passages")
    place = F.struct("doc", "version", "start")
    firsts = places.groupBy("anchor", "passage").agg(
        F.min(place).alias("first"), F.first("n").alias("n")
    )
    firsts = keep(firsts.select("anchor", "passage", "first.*", "n"), "first-passages")
    hot = firsts.groupBy("anchor").count().where(F.col("count") > HOT_PASSAGES).select("anchor")
    hot = keep(hot, "hot-anchors")
    total = firsts.agg(F.sum(F.col("n") + width - 1)).first()[0] or 0
    units = keep(_passage_words(docs, firsts, width), "passage-words")
    gone = _by_automata(units.join(hot, "anchor", "left_anti"), 1 + total // SHARD_WORDS, width)
    gone = keep(gone.unionByName(_by_window(units.join(hot, "anchor"), width)), "later-windows")
    judged = firsts.select("anchor", "passage", place.alias("first")).join(
        gone, ["anchor", "passage"], "left"
    )
    judged = keep(judged, "judged-passages")
    rows = places.join(judged, ["anchor", "passage"])
    run = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    at = F.col("start")
    later = F.array(run(at, at + F.col("n") - 1))  # a later place repeats every window of the first
    own = F.transform("gone", lambda i: run(at + i, at + i))
    rows = rows.select(
        "doc", "version", F.explode(F.when(F.col("first") == place, own).otherwise(later)).alias("run")
    )
    found = rows.groupBy("doc", "version").agg(F.collect_set("run").alias("windows"))
    found = keep(found, "repeated-windows")
    discard(docs.sparkSession, repeated, places, firsts, hot, units, gone, judged)
    return found


def _word_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    begins = ~textbytes.SPACE[data]
    inner = ends[1:-1][ends[1:-1] < len(data)]
    at_border = begins[inner]
    begins[1:] &= textbytes.SPACE[data[:-1]]
    begins[inner] = at_border
    return np.flatnonzero(begins)


def _spans(first: np.ndarray, last: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of the words in runs first..last."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last + 1, -1)
    gone = np.concatenate([[False], np.cumsum(change) > 0])
    return np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:]) - 1


def _cut(block: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[dict], bytes | None]]:
    """Per text: its number of words, the spans that go, and the text without them if any go."""
    data, ends = textbytes.utf8(block.column("text"))
    begins = _word_starts(data, ends)
    offsets = np.searchsorted(begins, ends)
    windows = block.column("windows")
    for row in range(block.num_rows):
        n_words = int(offsets[row + 1] - offsets[row])
        if not windows[row].is_valid:
            yield n_words, [], None
            continue
        runs = windows[row].values
        first, last = _spans(
            runs.field("first").to_numpy(), runs.field("last").to_numpy() + width - 1, n_words
        )
        # A span goes with the white space behind it.
        word_at = np.append(begins[offsets[row] : offsets[row + 1]], ends[row + 1])
        kept, at = [], ends[row]
        for a, b in zip(first, last, strict=True):
            kept.append(data[at : word_at[a]].tobytes())
            at = word_at[b + 1]
        kept.append(data[at : ends[row + 1]].tobytes())
        spans = [{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)]
        yield n_words, spans, b"".join(kept)


def _with_spans(docs: DataFrame, row: Column, id_col: str, text_col: str, width: int, anchor: int) -> DataFrame:
    """(row, text, n_words, n_removed, spans, kept_text) of every row."""
    found = repeated_windows(docs, id_col, text_col, width, anchor).withColumnsRenamed(
        {"doc": "at_doc", "version": "at_version"}
    )
    rows = docs.select(
        row.alias("row"), _id(id_col), text_key(F.col(text_col)).alias("version"), F.col(text_col).alias("text")
    )
    here = (F.col("doc") == F.col("at_doc")) & (F.col("version") == F.col("at_version"))
    rows = rows.join(found, here, "left").select("row", "text", "windows")

    def run(batches):
        for block in textbytes.blocks(batches, "text"):
            cut = list(_cut(block, width))
            texts = block.column("text").to_pylist()
            spans = [c[1] for c in cut]
            yield pa.record_batch(
                [
                    block.column("row"),
                    block.column("text"),
                    pa.array([c[0] for c in cut], pa.int64()),
                    pa.array([sum(s["last"] - s["first"] + 1 for s in x) for x in spans], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array(
                        [t if c[2] is None else c[2].decode() for t, c in zip(texts, cut, strict=True)], pa.string()
                    ),
                ],
                names=["row", "text", "n_words", "n_removed", "spans", "kept_text"],
            )

    schema = (
        f"row {rows.schema['row'].dataType.simpleString()}, text string, n_words long, n_removed long,"
        " spans array<struct<first: long, last: long>>, kept_text string"
    )
    return rows.mapInArrow(run, schema)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, anchor: int = 8
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans (first and last word) that go, and kept_text."""
    found = _with_spans(docs, F.col(id_col), id_col, text_col, width, anchor)
    return found.select(F.col("row").alias("doc_id"), "n_words", "n_removed", "spans", "kept_text")


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, anchor: int = 8
) -> DataFrame:
    """``docs`` with the spans cut out of the text; untouched texts (null too) stay as they are."""
    found = _with_spans(docs, F.struct(*docs.columns), id_col, text_col, width, anchor)
    columns = [F.col("kept_text" if c == text_col else f"row.{c}").alias(c) for c in docs.columns]
    return found.select(*columns)
