"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The encoding of a text by merges has two properties: cut between two tokens it falls into the
encodings of both parts, and a row of tokens is an encoding if each neighbouring pair is one. So
the last token of every prefix is unique: the token that ends there and goes with the last token
before it. A state holds the places where a longer token may still begin, each with the last token
before it and the count so far relative to the newest place; reading a character leads to one state
and emits the change of the count. States are compiled when first reached and numbered by content;
a full table is dropped and built anew, which bounds memory and changes no result. Where no token
goes on into a space after a word, the machine is back in its start state there, so what it emits
over a whole word is remembered as one long transition.

Texts of more than ``chunk`` characters are cut, and each chunk becomes a state map on its own: for
every token that may lie across its left edge, the tokens that may then lie across its right edge
and the tokens emitted between. Maps compose associatively; they are composed by blocks of
``SCAN`` chunks and then over the blocks. Of all ways through, one is an encoding.

Null and empty texts have no tokens. Rows that repeat an id and a text are counted each. Only the
id and text columns are read.
"""

from __future__ import annotations

import gc
import json
import re
from collections import Counter
from functools import cache

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrate.llm import textbytes
from spanrate.llm.text import text_key
from spanrate.llm.work import send_package

SPACE = "▁"
MAX_STATES = 120_000
MAX_PAIRS = 400_000
MAX_WORDS = 600_000
MAX_WORD = 64
#: States are made alike where at most so many longer tokens have to be tried.
MAX_LONGER = 16
SCAN = 256
END = "end"


class State(dict):
    """Transitions by character: (next state, emitted tokens); missing ones are compiled."""

    __slots__ = ("machine", "places")

    def __init__(self, machine: Transducer, places: tuple):
        super().__init__()
        self.machine = machine
        self.places = places

    def __missing__(self, char: str) -> tuple[State, int]:
        step = self.machine.step(self.places, char)
        self[char] = step
        return step


class Words(dict):
    """Emitted tokens by whole word, spaces before it included, read from the start state."""

    __slots__ = ("machine",)

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.run(self.machine.start, word)[1]
        if len(word) <= MAX_WORD:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = n
        return n


class Transducer:
    """Counts tokens of one vocabulary; ``places`` are (read, last token, relative count)."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        self.prefixes = {piece[:n] for piece in self.score for n in range(1, len(piece))}
        # Words can be read apart if no token goes on from a word into the next space.
        self.resets = not any(
            a != SPACE and b == SPACE for p in self.score for a, b in zip(p, p[1:], strict=False)
        )
        ordered = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = {model.id_to_piece(i): n for n, i in enumerate(ordered)}
        self.halves = {piece: self.last_merge(piece) for piece in self.score}
        tied = Counter(self.score[p] for p in self.score if len(p) > 1)
        #: Pieces whose halves all rank before them, with a rank of their own.
        self.regular = {
            p
            for p, (a, b) in self.halves.items()
            if not b
            or (tied[self.score[p]] == 1 and all(len(h) == 1 or self.rank[h] < self.rank[p] for h in (a, b)))
        }
        self.longer: dict[str, list[str]] = {}
        for piece in self.score:
            if len(piece) > 1 and self.halves[piece][1]:
                for n in range(1, len(piece)):
                    self.longer.setdefault(piece[:n], []).append(piece)
        self.goes: dict[tuple[str, str], bool] = {}
        self.stands: dict[tuple[str, str], str | None] = {}
        self.alike: dict[tuple, str] = {}
        self.states: dict[tuple, State] = {}
        self.start = self.state((("", "", 0),))
        self.words = Words(self)
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*").findall

    def state(self, places: tuple) -> State:
        found = self.states.get(places)
        if found is None:
            if len(self.states) >= MAX_STATES:
                for old in self.states.values():
                    old.clear()
                self.states = {self.start.places: self.start}
            found = self.states[places] = State(self, places)
        return found

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The encoding of a short text: the best pair merges first, the leftmost of equals."""
        parts = list(text)
        while True:
            if len(parts) <= stop:
                return parts
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def last_merge(self, piece: str) -> tuple[str, str]:
        """The two parts whose merge makes ``piece``; (piece, "") if it is no merge."""
        if len(piece) == 1:
            return piece, ""
        parts = self.merged(piece, 2)
        return (parts[0], parts[1]) if len(parts) == 2 and self.merged(piece) == [piece] else (piece, "")

    def apart(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two regular pieces, undoing the latest merge first."""
        rank, halves, score = self.rank, self.halves, self.score
        limit = len(rank)
        while True:
            both = left + right
            if both in score and rank[both] < limit:
                return False
            undo_left = len(left) > 1 and (len(right) == 1 or rank[left] > rank[right])
            if undo_left:
                limit = rank[left]
                left = halves[left][1]
            elif len(right) > 1:
                limit = rank[right] + 1
                right = halves[right][0]
            else:
                return True

    def standing(self, read: str, last: str) -> str | None:
        """One token for all that allow the same longer tokens after ``read``; None if none may come."""
        known = self.stands.get((read, last), "?")
        if known == "?":
            longer = self.longer.get(read, ())
            if len(longer) > MAX_LONGER:
                return last
            allowed = tuple(t for t in longer if self.follows(last, t, False))
            known = self.alike.setdefault((read, allowed), last) if allowed else None
            if len(self.stands) >= MAX_PAIRS:
                self.stands.clear()
            self.stands[read, last] = known
        return known

    def follows(self, left: str, right: str, remember: bool = True) -> bool:
        if not left:
            return self.merged(right) == [right]
        known = self.goes.get((left, right))
        if known is None:
            if left in self.regular and right in self.regular:
                known = self.apart(left, right)
            else:
                known = self.merged(left + right) == [left, right]
            if remember:
                if len(self.goes) >= MAX_PAIRS:
                    self.goes.clear()
                self.goes[left, right] = known
        return known

    def cost(self, token: str) -> int:
        return 1 if token in self.score else len(token.encode())

    def step(self, places: tuple, char: str) -> tuple[State, int]:
        newest = next((p for p in places if not p[0]), None)
        if self.resets and char == SPACE and newest and newest[1] and newest[1][-1] != SPACE:
            return self.start[char]
        token, count, longer = None, 0, []
        for read, last, n in places:
            read += char
            if token is None and (len(read) == 1 or read in self.score) and self.follows(last, read):
                token, count = read, n + self.cost(read)
            if read in self.prefixes:
                longer.append((read, last, n))
        if token is None:
            return self.state(tuple(longer)), 0
        moved = []
        for read, last, n in longer:
            if len(read) > 1:
                last = self.standing(read, last)
            if last is not None:
                moved.append((read, last, n - count))
        return self.state((*moved, ("", token, 0))), count

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for char in text:
            state, n = state[char]
            total += n
        return state, total

    def count(self, text: str) -> int:
        if not text:
            return 0
        whole = prepared(text)
        if not self.resets:
            return self.run(self.start, whole)[1]
        return sum(map(self.words.__getitem__, self.word(whole)))

    def across(self, text: str, cut: int) -> list[tuple[int, str]]:
        """(characters beyond the cut, token): every token that may hold the one before it."""
        if self.resets and cut < len(text) and text[cut] == SPACE and text[cut - 1] != SPACE:
            return [(0, "")]
        found = []
        for a in range(max(0, cut - self.longest), cut):
            for b in range(cut, min(len(text), a + self.longest) + 1):
                token = text[a:b]
                if token in self.score or len(token) == 1:
                    found.append((b - cut, token))
        return found

    def state_map(self, text: str, left: int, right: int, first: bool, last: bool) -> list:
        """[(entry, exit, tokens)] of the chunk text[left:right]; the rest is context."""
        exits = [END] if last else self.across(text, right)
        result = []
        tails: dict = {}
        # Most ways into a chunk meet at its first reset; what follows is read once.
        meet = left + self.longest
        if self.resets:
            while meet < right and not (text[meet] == SPACE and text[meet - 1] != SPACE):
                meet += 1
        meet = min(meet, right)
        for entry in [(0, "")] if first else self.across(text, left):
            begin = left + entry[0]
            state = self.state((("", entry[1], 0),))
            middle = max(begin, meet)
            state, head = self.run(state, text[begin:middle])
            if not state.places:
                continue
            if self.resets and middle < right and text[middle] == SPACE and middle > left:
                newest = next((p for p in state.places if not p[0]), None)
                if newest is None:
                    continue
                if newest[1] and newest[1][-1] != SPACE:
                    state = self.start
            key = (middle, state.places)
            if key not in tails:
                tails[key] = self.run(state, text[middle:right])
            end, tail = tails[key]
            for way in exits:
                n = self._leaves(end, text, right, way)
                if n is not None:
                    result.append((entry, way, head + tail + n))
        return result

    def _leaves(self, state: State, text: str, cut: int, way) -> int | None:
        """Tokens still to count for one way out, or None if it cannot be."""
        for read, last, n in state.places:
            if way == END or way[1] == "":
                if not read:
                    return 0
            elif way[0] == 0 and not read and last == way[1]:
                return 0
            elif way[0] > 0 and read and read == way[1][: len(way[1]) - way[0]] and text[cut - len(read) : cut] == read:
                if self.follows(last, way[1]):
                    return n + self.cost(way[1])
        return None


@cache
def transducer(model_path: str) -> Transducer:
    return Transducer(model_path)


def prepared(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def compose(maps: list[list]) -> list:
    """One map from consecutive ones."""
    whole = None
    for part in maps:
        part = [(_way(a), _way(b), n) for a, b, n in part]
        if whole is None:
            whole = {(a, b): n for a, b, n in part}
            continue
        onward: dict = {}
        for a, b, n in part:
            onward.setdefault(a, []).append((b, n))
        whole = {(a, c): n + m for (a, b), n in whole.items() for c, m in onward.get(b, ())}
    return [(a, b, n) for (a, b), n in (whole or {}).items()]


def _way(way):
    return way if way == END else tuple(way)


def _counter(model_path: str):
    def count(batches):
        machine = transducer(model_path)
        for block in textbytes.blocks(batches, "text"):
            texts = block.column("text").to_pylist()
            gc.disable()  # nothing here is garbage, and states are many
            try:
                counts = [machine.count(t) if t else 0 for t in texts]
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return count


def _mapper(model_path: str):
    def map_chunks(batches):
        machine = transducer(model_path)
        for batch in batches:
            for row in batch.to_pylist():
                parts = machine.state_map(row["part"], row["left"], row["right"], row["first"], row["last"])
                row["map"] = json.dumps(parts)
                names = ["doc_id", "version", "n_bytes", "chunk", "map"]
                yield pa.RecordBatch.from_pylist(
                    [{k: row[k] for k in names}],
                    schema=pa.schema(
                        [(k, pa.string() if k == "map" else pa.int64()) for k in names]
                    ),
                )

    return map_chunks


def _composer(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one text and block of chunks become one; repeated rows are counted."""
    first = frame.iloc[:1][["doc_id", "version", "n_bytes", "block"]].copy()
    times = int((frame["chunk"] == frame["chunk"].min()).sum())
    ordered = frame.drop_duplicates("chunk").sort_values("chunk")
    first["map"] = json.dumps(compose([json.loads(m) for m in ordered["map"]]))
    first["times"] = times if "times" not in frame else int(frame["times"].iloc[0])
    return first


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 65_536,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row of ``docs``."""
    if chunk < 64:
        raise ValueError("chunks must be longer than the longest token")
    send_package(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumns(
        {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")}
    )
    is_long = F.coalesce(F.char_length(text) > chunk, F.lit(False))
    short = rows.where(~is_long).mapInArrow(
        _counter(model_path), "doc_id long, n_bytes long, n_tokens long"
    )
    return short.union(_count_long(rows.where(is_long), model_path, chunk))


def _count_long(rows: DataFrame, model_path: str, chunk: int) -> DataFrame:
    context = 32
    size = F.char_length("whole")
    whole = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    named = rows.select("doc_id", text_key(F.col("text")).alias("version"), "n_bytes", whole.alias("whole"))
    begin = F.col("chunk") * chunk
    left = F.least(begin, F.lit(context).cast("long"))
    stop = F.least(begin + chunk, F.col("size"))
    chunks = named.select(
        "doc_id",
        "version",
        "n_bytes",
        "whole",
        size.cast("long").alias("size"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / chunk))).alias("chunk"),
    ).select(
        "doc_id",
        "version",
        "n_bytes",
        "chunk",
        F.substring(
            "whole", (begin - left + 1).cast("int"), (stop - begin + left + context).cast("int")
        ).alias("part"),
        left.alias("left"),
        (left + stop - begin).alias("right"),
        (F.col("chunk") == 0).alias("first"),
        (stop == F.col("size")).alias("last"),
    )
    # Only chunks move: a very long text is read by as many tasks as it has chunks.
    spread = chunks.repartition("doc_id", "version", "chunk")
    maps = spread.mapInArrow(
        _mapper(model_path), "doc_id long, version long, n_bytes long, chunk long, map string"
    ).withColumn("block", F.floor(F.col("chunk") / SCAN))
    schema = "doc_id long, version long, n_bytes long, block long, map string, times long"
    blocks = maps.groupBy("doc_id", "version", "block").applyInPandas(_composer, schema)
    texts = blocks.withColumnRenamed("block", "chunk").withColumn("block", F.lit(0).cast("long"))
    whole_map = texts.groupBy("doc_id", "version").applyInPandas(_composer, schema)
    tokens = F.from_json("map", "array<array<string>>")[0][2].cast("long")
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    return whole_map.select("doc_id", "n_bytes", tokens.alias("n_tokens"), repeated.alias("i")).drop("i")
