"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

Both tokenizers write a text, with a space before it, as tokens that tile its bytes. In a batch, every
token start of one side finds the other side's covering token by ``pandas.merge_asof``, keyed by
document; both directions together give all overlaps, and the overlaps whose ends are equal cut the
tokens into groups. All tokens of a group are linked across the sides.

A single space between two visible characters is a cut for both tokenizers (see ``CUT``), and the
tokens between two cuts depend on nothing else. So the unit that a batch encodes and aligns is the
stretch between cuts, each different one once while a task remembers it; a document is the sequence
of its stretches. Long texts are taken in parts of ``PART`` characters, up to the next cut.

How many documents hold a pair of ids is counted over the corpus: every document gives its different
pairs once, batches and tasks add up before the shuffle. Documents look their pairs up in two ways:
the at most ``FREQUENT`` pairs found in the most documents are broadcast (13 bytes each), all others
are joined by pair. Both give the same figures.

Null and empty texts have no tokens, nor have texts whose token bytes differ from the text on either
side (a literal U+2581, say): all figures are 0 and ``groups`` is empty. Rows that repeat an id or a
text are documents of their own. Only id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrate.llm import textbytes
from spanrate.llm.work import discard, keep, send_package

#: The byte-level pre-tokenizer never joins a space to what precedes it, and no piece of the other
#: vocabulary holds a word break behind another character (``_pieces`` refuses one that does). The
#: class leaves out whatever any library may take for white space.
CUT = re.compile("(?<=[!-~À-ᙿ]) (?=[!-~À-ᙿ])")
PART = 1 << 20
KNOWN = 1 << 19
FREQUENT = 1 << 20
WORD_BREAK = "▁"


def _byte_symbols() -> dict[str, int]:
    """Characters of a byte-level vocabulary: visible Latin-1 stands for itself, the rest follows 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteTokens:
    """A byte-level vocabulary; special strings inside texts are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        symbols = _byte_symbols()
        self.bytes = [
            bytes(symbols[c] for c in self.model.id_to_token(i) or "") for i in range(self.model.get_vocab_size())
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [f.ids for f in found]


class PieceTokens:
    """A sentencepiece vocabulary with byte fallback, which adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if WORD_BREAK in piece.lstrip(WORD_BREAK):
                raise ValueError(f"piece {i} spans words, so texts cannot be cut at spaces")
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace(WORD_BREAK, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> ByteTokens | PieceTokens:
    return PieceTokens(path) if path.endswith(".model") else ByteTokens(path)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, id) of all tokens."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
    return np.repeat(np.arange(len(ids)), sizes), flat


def _tiled(doc: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
    """(doc, at, end, id) of all tokens, ``at`` counted over all documents."""
    end = np.cumsum(lengths[flat])
    return pd.DataFrame({"doc": doc, "at": end - lengths[flat], "end": end, "id": flat})


def groups_of(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token, numbered over all documents, from two tilings of the same bytes."""
    a, b = (x.assign(token=np.arange(len(x))) for x in (a, b))
    columns = ["doc", "at", "end", "token"]
    down = pd.merge_asof(a[columns], b[columns], on="at", by="doc", suffixes=("_a", "_b"))
    up = pd.merge_asof(b[columns], a[columns], on="at", by="doc", suffixes=("_b", "_a"))
    overlaps = pd.concat([down, up])
    cuts = overlaps[overlaps.end_a == overlaps.end_b]
    found = []
    for tokens, side in ((a, "token_a"), (b, "token_b")):
        last = np.zeros(len(tokens), np.int64)
        last[cuts[side].to_numpy(np.int64)] = 1
        found.append(np.cumsum(last) - last)
    return found[0], found[1]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Stretches:
    """Different stretches, aligned: counts, groups as text, and links as pair codes.

    A task keeps what it has aligned until there are ``KNOWN`` stretches or links, then starts anew.
    """

    def __init__(self, a: ByteTokens | PieceTokens, b: ByteTokens | PieceTokens):
        self.sides = a, b
        self.lengths = [np.array([len(x) for x in t.bytes]) for t in self.sides]
        # The ids as text, with what follows: another token of the side, side b, or another group.
        self.names = np.array(
            [f"{i}{sign}" for t, signs in zip(self.sides, (",|", ",;"), strict=True) for sign in signs
             for i in range(len(t.bytes))],
            object,
        )
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.tiles = np.zeros(0, bool)
        self.n_a, self.n_b, self.n_groups, self.n_links, self.first_link, self.codes = np.zeros((6, 0), np.int64)
        self.groups: list[str] = []

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """The numbers of the stretches in each text; unknown ones are aligned in one go."""
        if len(self.known) > KNOWN or len(self.codes) > 4 * KNOWN:
            self._clear()
        known, before = self.known, len(self.known)
        found = [[known.setdefault(s, len(known)) for s in own] for own in texts]
        if len(known) > before:
            self._add(list(islice(known, before, None)))
        return found

    def _add(self, texts: list[str]) -> None:
        a, b = self.sides
        found = [_flat(t.encode(texts)) for t in self.sides]
        tiles = self._tiling(texts, found)
        found = [(doc[tiles[doc]], flat[tiles[doc]]) for doc, flat in found]
        ta, tb = (_tiled(*x, n) for x, n in zip(found, self.lengths, strict=True))
        ga, gb = groups_of(ta, tb)
        n_groups = int(ga[-1]) + 1 if len(ga) else 0
        in_a, in_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        per_text = np.bincount(ta.doc.to_numpy()[first_a], minlength=len(texts))
        n_a, n_b = (np.bincount(t.doc, minlength=len(texts)) for t in (ta, tb))
        # Every token of side a meets all tokens of its group's side b.
        per_token = in_b[ga]
        codes = np.repeat(ta.id.to_numpy() * len(b.bytes), per_token)
        codes += tb.id.to_numpy()[_ranges(first_b[ga], per_token)]
        n_links = np.bincount(ta.doc.to_numpy(), weights=per_token, minlength=len(texts)).astype(np.int64)
        self.groups += self._spelled((ta.id.to_numpy(), tb.id.to_numpy()), (ga, gb), (in_a, in_b), n_a + n_b)
        more = {
            "tiles": tiles,
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": per_text,
            "n_links": n_links,
            "first_link": len(self.codes) + np.cumsum(n_links) - n_links,
            "codes": codes,
        }
        for name, values in more.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))

    def _tiling(self, texts: list[str], found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether the bytes of both sides' tokens are those of the text with a space before it."""
        wanted = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
        tiles = np.ones(len(texts), bool)
        for (doc, flat), lengths in zip(found, self.lengths, strict=True):
            tiles &= np.bincount(doc, weights=lengths[flat], minlength=len(texts)).astype(np.int64) == wanted
        same = np.flatnonzero(tiles)
        whole = np.frombuffer("".join([" " + texts[i] for i in same.tolist()]).encode(), np.uint8)
        ends, kept = np.cumsum(wanted[same]), tiles.copy()
        for (doc, flat), side in zip(found, self.sides, strict=True):
            own = b"".join(map(side.bytes.__getitem__, flat[kept[doc]].tolist()))
            wrong = np.flatnonzero(np.frombuffer(own, np.uint8) != whole)
            tiles[same[np.unique(np.searchsorted(ends, wrong, "right"))]] = False
        return tiles

    def _spelled(self, ids, groups, sizes, n_tokens: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text: side b's tokens of a group follow side a's."""
        (a, b), (ga, gb), (in_a, in_b) = ids, groups, sizes
        size_a, size_b = (len(t.bytes) for t in self.sides)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in groups)
        named = np.zeros(len(a) + len(b), np.int64)
        named[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[ga]] = a + size_a * last_a
        named[np.arange(len(b)) + np.cumsum(in_a)[gb]] = 2 * size_a + b + size_b * last_b
        spelled = self.names[named].tolist()
        ends = np.cumsum(n_tokens)
        return ["".join(spelled[x:y])[:-1] for x, y in zip((ends - n_tokens).tolist(), ends.tolist(), strict=True)]


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        cut = CUT.search(text, at + PART)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class _Found:
    """What is known of one document so far."""

    def __init__(self):
        self.sums = np.zeros(4, np.int64)
        self.groups: list[str] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.tiles = True

    def row(self) -> tuple:
        if not self.tiles or not self.pairs:
            return 0, 0, 0, 0, "", b"", b""
        if len(self.pairs) == 1:
            codes, times = self.pairs[0]
        else:
            codes, at = np.unique(np.concatenate([p[0] for p in self.pairs]), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate([p[1] for p in self.pairs]))
        codes, times = codes.astype("<i8"), times.astype("<i4")
        if len(codes) and codes[-1] < 2**31:
            codes = codes.astype("<i4")
        return *map(int, self.sums), ";".join(self.groups), codes.tobytes(), times.tobytes()


def _align_parts(parts: list[tuple[_Found, str]], stretches: Stretches) -> None:
    """Add what the parts hold to their documents."""
    pieces = stretches.numbers([CUT.split(text) for _, text in parts])
    for (found, _), own in zip(parts, pieces, strict=True):
        at = np.array(own)
        if not found.tiles or not stretches.tiles[at].all():
            found.tiles = False
            continue
        found.sums += [x[at].sum() for x in (stretches.n_a, stretches.n_b, stretches.n_groups, stretches.n_links)]
        found.groups.append(";".join(map(stretches.groups.__getitem__, own)))
        kinds, often = np.unique(at, return_counts=True)
        links = stretches.n_links[kinds]
        codes = stretches.codes[_ranges(stretches.first_link[kinds], links)]
        order = np.argsort(codes, kind="stable")
        codes, often = codes[order], np.repeat(often, links)[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else order
        found.pairs.append((codes[first], np.add.reduceat(often, first) if len(first) else often))


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups", "codes", "times"]
_TYPES = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]


def token_groups(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``) and the different
    linked pairs: codes (a * size of vocabulary b + b; 4 bytes each, 8 if any needs them) and times."""
    send_package(docs.sparkSession)

    def run(batches):
        stretches = Stretches(tokens_of(path_a), tokens_of(path_b))
        for block in textbytes.blocks(batches, "text"):
            rows = [_Found() for _ in range(block.num_rows)]
            waiting, size = [], 0
            for found, text in zip(rows, block.column("text").to_pylist(), strict=True):
                for part in _parts(text) if text else ():
                    waiting.append((found, part))
                    size += len(part)
                    if size >= PART:
                        _align_parts(waiting, stretches)
                        waiting, size = [], 0
            if waiting:
                _align_parts(waiting, stretches)
            columns = list(zip(*[f.row() for f in rows], strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
            yield pa.record_batch([block.column("doc_id"), *arrays], names=["doc_id", *_COLUMNS])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, codes binary, times binary",
    )


def _codes(raw: pa.Array, times: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, times) of all pairs in a batch."""
    own_codes, own_times, sizes = [], [], []
    for c, t in zip(raw, times, strict=True):
        t = np.frombuffer(t.as_buffer(), "<i4")
        c = c.as_buffer()
        own_codes.append(np.frombuffer(c, "<i4" if c.size == 4 * len(t) else "<i8").astype(np.int64))
        own_times.append(t)
        sizes.append(len(t))
    none = [np.zeros(0, np.int64)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.concatenate(own_codes or none), np.concatenate(own_times or none).astype(np.int64)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(code, n_docs, best): documents that hold the pair, and whether none of its a id has more."""

    def run(batches):
        for batch in batches:
            _, codes, _ = _codes(batch.column("codes"), batch.column("times"))
            code, n = np.unique(codes, return_counts=True)
            yield pa.record_batch([pa.array(code), pa.array(n)], names=["code", "n"])

    counts = found.select("codes", "times").mapInArrow(run, "code long, n long")
    counts = counts.groupBy("code").agg(F.sum("n").alias("n_docs"))
    counts = counts.withColumn("a", F.floor(F.col("code") / size_b))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("code", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, limit: int) -> int:
    """The least power of two that at most ``limit`` pairs reach."""
    level = F.length(F.bin("n_docs")).alias("level")
    sizes = dict(counts.groupBy(level).count().collect())
    total, least = 0, max(sizes, default=0) + 1
    while least > 1 and total + sizes.get(least - 1, 0) <= limit:
        least -= 1
        total += sizes.get(least, 0)
    return 1 << (least - 1) if least > 0 else 1


def align_tokens(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 ('' without tokens), n_best (links
    whose pair no other of its a id beats) and count_sum (documents that hold the pair, over links)."""
    size_b = len(tokens_of(path_b).bytes)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = token_groups(docs, path_a, path_b, id_col, text_col).withColumn("groups_sha256", digest)
    found = keep(found.drop("groups").withColumn("row", F.monotonically_increasing_id()), "token-groups")
    counts = keep(pair_counts(found, size_b), "pair-counts")
    least = _frequent(counts, frequent)
    top = counts.where(F.col("n_docs") >= least).toArrow().combine_chunks().sort_by("code")
    known = found.sparkSession.sparkContext.broadcast(
        tuple(top[c].to_numpy() for c in ("code", "n_docs", "best"))
    )

    def run(batches):
        code, n_docs, best = known.value
        for batch in batches:
            row, codes, times = _codes(batch.column("codes"), batch.column("times"))
            at = np.searchsorted(code, codes)
            hit = at < len(code)
            hit[hit] = code[at[hit]] == codes[hit]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], row[hit], times[hit] * n_docs[at[hit]])
            rest = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))])
            lists = [pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(x[~hit])) for x in (codes, times)]
            kept = [batch.column(c) for c in columns]
            yield pa.record_batch([*kept, *map(pa.array, sums), *lists], names=[*columns, "n_best", "count_sum", "rest", "rest_times"])

    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = found.schema["doc_id"].dataType.simpleString()
    rows = found.mapInArrow(
        run,
        f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        " n_best long, count_sum long, rest array<long>, rest_times array<long>",
    )
    rows = keep(rows, "token-pairs")
    rest = rows.select("row", F.inline(F.arrays_zip(F.col("rest").alias("code"), F.col("rest_times").alias("times"))))
    rest = rest.join(counts.where(F.col("n_docs") < least), "code")
    more = rest.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"),
    )
    result = rows.join(more, "row", "left").select(
        *columns[1:],
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )
    result = keep(result, "token-alignment")
    discard(docs.sparkSession, found, counts, rows)
    return result
