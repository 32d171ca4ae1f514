"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
INDEXED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, width: int) -> frozenset:
    words = SPACED.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(texts: dict[int, str | None], width: int, percent: int = 80) -> dict[int, int]:
    """Smallest reachable id by id; links by a full comparison of all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def base_measures(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = SPACED.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def contamination(texts, items, window: int = 10):
    """(n_words, n_hit, item ids) per text."""
    found = []
    grams = [(str(i) if i is not None else "", INDEXED.findall((t or "").translate(LOWER))) for i, t in items]
    for text in texts:
        words = INDEXED.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for name, own in grams:
            k = min(len(own), window)
            for s in range(len(own) - k + 1) if own else ():
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == own[s : s + k]:
                        hit.update(range(p, p + k))
                        ids.add(name)
        found.append((len(words), len(hit), sorted(ids)))
    return found


def drop_lines(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, str]]:
    """(n_lines, n_dropped, text) per (id, text)."""

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    low = -(2**63)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(low if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = low if i is None else i
        gone = [len(holders[key(x)]) >= 3 and own != max(holders[key(x)]) if key(x) in holders else False for x in lines]
        kept = [x for x, g in zip(lines, gone, strict=True) if not g]
        out.append((len(lines), sum(gone), "\n".join(kept)))
    return out


def symbol(c: str) -> str:
    """What a character counts as in the n-gram model."""
    if c in " \t\n\x0b\x0c\r":
        return " "
    if c in "0123456789":
        return "0"
    if c.isascii():
        return c.lower() if c.isalpha() else "#"
    return c


class KneserNey:
    """Modified Kneser-Ney of order 4 over symbols, with dictionaries."""

    def __init__(self, texts):
        self.counts = {k: Counter() for k in (1, 2, 3, 4)}
        #: Texts that hold a gram, or a context (which has a symbol behind it).
        self.holders, self.followed = defaultdict(set), defaultdict(set)
        for text in texts:
            padded = [" "] * 3 + [symbol(c) for c in text]
            own = [tuple(padded[i : i + 4]) for i in range(len(padded) - 3)]
            self.counts[4].update(own)
            for gram in own:
                for k in range(4):
                    self.holders[gram[k:]].add(text)
                    self.followed[gram[k:-1]].add(text)
        for k in (3, 2, 1):
            self.counts[k].update(gram[1:] for gram in self.counts[k + 1])
        self.alphabet = {gram[0] for gram in self.counts[1]}
        self.after = {k: {} for k in self.counts}
        for k, counts in self.counts.items():
            for gram, n in counts.items():
                self.after[k].setdefault(gram[:-1], []).append(n)
        self.discounts = {}
        for k, counts in self.counts.items():
            n = [max(1, sum(x == i for x in counts.values())) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            self.discounts[k] = [min(i - 0.05, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]

    def probability(self, gram):
        if not gram:
            return 1 / len(self.alphabet)
        k = len(gram)
        after = self.after[k].get(gram[:-1])
        if after is None:
            return self.probability(gram[1:])
        off = lambda n: self.discounts[k][min(n, 3) - 1]
        n = self.counts[k][gram]
        own = n - off(n) if n else 0.0
        return (own + sum(map(off, after)) * self.probability(gram[1:])) / sum(after)

    def by_others(self, gram):
        """The probability for the text that holds ``gram`` if no other does."""
        if not gram or len(self.holders[gram]) > 1:
            return self.probability(gram)
        k, lower = len(gram), self.by_others(gram[1:])
        if len(self.followed[gram[:-1]]) < 2:
            return lower
        after = self.after[k][gram[:-1]]
        return sum(self.discounts[k][min(n, 3) - 1] for n in after) / sum(after) * lower
