"""Substring dedup, the conversation prefix trie and token alignment against plain Python versions."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import SPACED
from pyspark.sql import functions as F

from spanrate.llm import prefix_trie as trie
from spanrate.llm import suffix_shards as shards
from spanrate.llm import token_alignment as align
from spanrate.llm.text import space_words

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute_repeats(rows, width):
    """(n_words, n_removed, kept words) per distinct (id order, text); rows as (order, text)."""
    seen, found = set(), {}
    for order, text in sorted(set(rows), key=lambda r: r[0]):
        words = SPACED.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            window = tuple(words[s : s + width])
            if window in seen:
                gone[s : s + width] = [True] * width
            seen.add(window)
        found[order] = (len(words), sum(gone), [w for w, g in zip(words, gone, strict=True) if not g])
    return found


def check_repeats(spark, rows, width=20, anchor=8):
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, row int, windows string")
    keyed = docs.select(shards._id("doc_id"), shards.text_key(F.col("text")).alias("v"), "text").collect()
    expected = brute_repeats([((r.doc, r.v), r.text) for r in keyed], width)
    wanted = Counter(
        (None if r.doc == shards.LOWEST else r.doc, *expected[r.doc, r.v][:2], " ".join(expected[r.doc, r.v][2]))
        for r in keyed
    )
    found = shards.repeated_spans(docs, width=width, anchor=anchor)
    kept = F.array_join(space_words(F.col("kept_text")), " ")
    assert Counter(map(tuple, found.select("doc_id", "n_words", "n_removed", kept).collect())) == wanted


def repeats_rows(words, n=40):
    draw = random.Random(3)
    text = lambda k: [draw.choice(words) for _ in range(k)]
    common = text(60)
    rows = [(1, " ".join(common)), (2, " ".join(common)), (2, " ".join(common)), (3, None), (4, ""), (5, " \n\t")]
    for i in range(6, n):
        start, size = draw.randrange(40), draw.randrange(15, 30)
        middle = common[start : start + size]
        rows.append((i, "\n".join([" ".join(text(draw.randrange(30))), "  ".join(middle), " ".join(text(9))])))
    rows += [(n, "a " * 200), (n + 1, "a b " * 90 + "c"), (None, " ".join(common[5:50])), (2, " ".join(common[9:]))]
    rows += [(n + 2, " ".join(text(30_000) + common)), (n + 3, "é \U0001f600 " * 40)]
    return [(i, t, "x", 1, "y") for i, t in rows]


def test_repeats_equal_brute_force(spark, words, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_WORDS", 500)
    check_repeats(spark, repeats_rows(words))


def test_hot_anchors_and_cut_texts_change_nothing(spark, words, monkeypatch):
    monkeypatch.setattr(shards, "HOT_PASSAGES", 2)
    monkeypatch.setattr(shards, "SEGMENT", 37)
    check_repeats(spark, repeats_rows(words), width=10, anchor=4)


def test_repeats_of_an_empty_table_and_cut_out_spans(spark, words):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shards.repeated_spans(empty).count() == 0
    common = " ".join(words[:25])
    docs = spark.createDataFrame(
        [(1, f"one\n\n{common} end", "k"), (2, f"two\n\n{common}  fin ", "l"), (3, None, "m")],
        "doc_id long, text string, windows string",
    )
    kept = {r.doc_id: r for r in shards.drop_repeats(docs).collect()}
    assert kept[1].text == f"one\n\n{common} end" and kept[2].text == "two\n\nfin " and kept[3].text is None
    assert kept[2].windows == "l" and list(kept[2].asDict()) == docs.columns
    spans = {r.doc_id: r.spans for r in shards.repeated_spans(docs).collect()}
    assert spans[1] == [] and [tuple(s) for s in spans[2]] == [(1, 25)]


def test_matching_statistics_equal_a_plain_search():
    draw = random.Random(2)
    for _ in range(30):
        sequences = [[draw.randrange(3) for _ in range(draw.randrange(1, 25))] for _ in range(4)]
        automaton = shards.PassageAutomaton()
        for number, sequence in enumerate(sequences):
            automaton.add(number, sequence)
        asked = [draw.randrange(4) for _ in range(30)]
        for at, (size, first) in enumerate(automaton.matches(asked, 5)):
            ends = lambda k: [
                (n, e)
                for n, s in enumerate(sequences)
                for e in range(k - 1, len(s))
                if s[e - k + 1 : e + 1] == asked[at - k + 1 : at + 1]
            ]
            longest = max((k for k in range(1, min(5, at + 1) + 1) if ends(k)), default=0)
            assert size == longest and (not size or first == min(ends(size)))


def brute_trie(conversations):
    """The nodes of {conv_id: turns} as the operator returns them."""
    members, below = defaultdict(list), defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    totals, found = {}, []
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(SPACED.findall(node[-1][1])) if node else 0
        leaves = sum(totals[c][0] for c in below[node]) if below[node] else 1
        totals[node] = leaves, own + sum(totals[c][1] for c in below[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(conversations[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        found.append(
            (min(members[node]), len(node), parent, len(members[node]), len(below[node]), *totals[node], digest)
        )
    return Counter(found)


def trie_rows():
    draw = random.Random(8)
    said = ["a b", "c", "a b c", ""]
    rows = []
    for conv in list(range(0, 70)) + [1000, 999999999]:
        for turn in range(draw.randrange(1, 6)):
            rows.append((conv, turn, draw.choice(["user", "bot"]), draw.choice(said)))
    rows += [(80, t, "user", f"t {t}") for t in range(60)] + [(83, t, "user", f"t {t}") for t in range(50)]
    rows += [(90, None, "user", "first"), (90, -1, None, None), (90, 2, "bot", "x"), (90, 2, "bot", "x")]
    rows += [(None, 1, "user", "nobody"), (101, 0, "user", "only own")]
    return rows


def ordered(rows):
    found = defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "")
    for conv, _, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        found[conv].append((role or "", text or ""))
    return found


@pytest.mark.parametrize("least_heavy", [1, 5, 1024])
@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_brute_force(spark, least_heavy, rebuild, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = trie_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({c: F.lit("x") for c in ("depth", "k1", "digest", "n_turns", "part")})
    own = ordered(rows)
    if rebuild:
        heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: heads[c]] + own[c][heads[c] :] for c in own}
    found = trie.prefix_trie(trie.conversation_prefixes(frame, rebuild=rebuild), least_heavy)
    assert Counter(map(tuple, found.collect())) == brute_trie(own)


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert trie.prefix_trie(trie.conversation_prefixes(empty, rebuild=True)).count() == 0
    turnless = [c for c in range(100, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3]
    rows = spark.createDataFrame([(c, 0, "u", "t") for c in turnless], schema)
    found = trie.prefix_trie(trie.conversation_prefixes(rows, rebuild=True)).collect()
    assert [(r.depth, r.n_convs, r.n_leaves) for r in found] == [(0, len(turnless), 1)]


def test_a_queue_that_spills_gives_everything_in_order():
    draw = np.random.default_rng(4)
    queue, held, out = trie.SpillingQueue(limit=10), [], []
    for value in draw.integers(0, 50, 3000).tolist():
        queue.push((value, -value, 2**62))
        held.append((value, -value, 2**62))
        if value % 3 == 0:
            least = min(held)
            held.remove(least)
            assert queue.least() == least and queue.pop() == least
    while queue.least() is not None:
        out.append(queue.pop())
    assert out == sorted(held) and queue.n_runs > 5


def test_totals_to_a_missing_node_are_an_error():
    with pytest.raises(ValueError, match="not in this shard"):
        list(trie.time_forward(iter([(2, 1, 1, 5, 5, False, 1, 0), (1, 6, 6, 0, 0, True, 1, 0)])))


def brute_alignment(rows):
    a, b = align.tokens_of(BYTES), align.tokens_of(PIECES)
    docs, holders = [], Counter()
    for doc, text in rows:
        ids = [side.encode([text])[0] for side in (a, b)] if text else [[], []]
        tiles = all(b"".join(s.bytes[i] for i in x) == f" {text}".encode() for s, x in zip((a, b), ids, strict=True))
        if not text or not tiles:
            docs.append((doc, 0, 0, [], Counter()))
            continue
        ends = [np.cumsum([len(s.bytes[i]) for i in x]).tolist() for s, x in zip((a, b), ids, strict=True)]
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append(tuple([i for i, e in zip(x, y, strict=True) if low < e <= cut] for x, y in zip(ids, ends, strict=True)))
            low = cut
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        holders.update(links.keys())
        docs.append((doc, len(ids[0]), len(ids[1]), groups, links))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    found = Counter()
    for doc, n_a, n_b, groups, links in docs:
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for p, n in links.items() if holders[p] == most[p[0]])
        total = sum(n * holders[p] for p, n in links.items())
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        found[doc, n_a, n_b, len(groups), links.total(), digest, best, total] += 1
    return found


def alignment_rows(words):
    draw = random.Random(6)
    odd = [
        None, "", " ", "a  b", "<0x41> <s> </s> <unk>", " lead", "trail ", "tab\tx\n\ny", "a▁b c", "\x00 a", "it 's",
        "<|endoftext|> x", "é f", "　 x   y", "日本 語 です", "\U0001f600 a \U0001f600", "x" * 700, "a\x1c b", "a​ b",
    ]
    rows = [(i, t) for i, t in enumerate(odd)] + [(7, "same id"), (7, "same id"), (None, "no id é")]
    symbols = ["a", "B", " ", " ", "  ", "\n", "é", "1", ".", "'s", "ß", "の", "-", "́", " ", "Ж"]
    rows += [(100 + i, "".join(draw.choices(symbols, k=draw.randrange(60)))) for i in range(150)]
    return rows + [(i, " ".join(draw.choices(words, k=40))) for i in range(300, 320)]


@pytest.mark.parametrize("frequent", [0, 30, align.FREQUENT])
def test_alignment_equals_brute_force(spark, words, frequent):
    rows = alignment_rows(words)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, row string, codes string")
    found = align.align_tokens(docs, BYTES, PIECES, frequent=frequent).collect()
    assert Counter(map(tuple, found)) == brute_alignment(rows)


def test_cut_texts_are_encoded_as_whole_ones(words, monkeypatch):
    draw = random.Random(9)
    text = " ".join(draw.choices([*words, "1,5", "é.", "'s", "x  y", "\n", "日本"], k=4000))
    sides = align.tokens_of(BYTES), align.tokens_of(PIECES)
    monkeypatch.setattr(align, "PART", 100)
    parts = list(align._parts(text))
    assert len(parts) > 50 and " ".join(parts) == text
    for side in sides:
        stretches = [s for part in parts for s in align.CUT.split(part)]
        assert sum(side.encode(stretches), []) == side.encode([text])[0]


def test_parts_and_forgotten_stretches_change_nothing(spark, words, monkeypatch):
    rows = alignment_rows(words)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = Counter(map(tuple, align.token_groups(frame, BYTES, PIECES).collect()))
    stretches = align.Stretches(align.tokens_of(BYTES), align.tokens_of(PIECES))
    monkeypatch.setattr(align, "PART", 20)
    monkeypatch.setattr(align, "KNOWN", 5)
    found = Counter()
    for doc, text in rows:
        held = align._Found()
        for part in align._parts(text) if text else ():
            align._align_parts([(held, part)], stretches)
        found[(doc, *held.row())] += 1
    assert found == Counter({(*r[:6], bytes(r[6]), bytes(r[7])): n for r, n in whole.items()})


def test_alignment_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_tokens(empty, BYTES, PIECES).count() == 0


def test_alignment_calls_do_not_grow_with_the_groups():
    """Groups are spelled and bytes compared per batch, not by a call per group or text."""
    stretches = align.Stretches(align.tokens_of(BYTES), align.tokens_of(PIECES))
    joins = []
    sys.setprofile(lambda _, event, what: joins.append(1) if event == "c_call" and what.__name__ == "join" else None)
    try:
        stretches.numbers([["first,second;third:" * 200]])
    finally:
        sys.setprofile(None)
    assert stretches.n_groups[0] > 1000 and len(joins) < 100


def test_alignment_of_texts_that_do_not_tile_beside_others():
    texts = ["▁", "a word", "ﬁn", "x▁y", "café 中", "▁▁"]
    both = align.Stretches(align.tokens_of(BYTES), align.tokens_of(PIECES))
    both.numbers([[t] for t in texts])
    for at, text in enumerate(texts):
        one = align.Stretches(*both.sides)
        one.numbers([[text]])
        assert (one.tiles[0], one.groups[0], one.n_links[0]) == (both.tiles[at], both.groups[at], both.n_links[at])
    assert not both.tiles[0] and both.groups[0] == "" and both.tiles[1]
