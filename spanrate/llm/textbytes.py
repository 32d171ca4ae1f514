"""Whole batches of texts as UTF-8 bytes: words and word hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: Bytes handled at once; a longer text is cut between words.
PIECE = 1 << 20
#: Texts gathered at once.
BLOCK = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_CODES[SPACE] = 0
_powers = np.ones(1, np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def blocks(batches: Iterator[pa.RecordBatch], text_col: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` (``BLOCK``) bytes of text each, whole rows always."""
    size = size or BLOCK
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = utf8(batch.column(text_col))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + size, "right")) - 1
            stop = max(start + 1, stop)
            yield batch.slice(start, stop - start)
            start = stop


def mixed(values: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64, 2 * len(_powers)), _ODD, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def _cuts(data: np.ndarray) -> list[int]:
    """Ends of the pieces; each but the last ends behind white space."""
    cuts, at = [], 0
    while len(data) - at > PIECE:
        stop = at + PIECE
        while True:
            spaces = np.flatnonzero(SPACE[data[stop - 1 : stop + PIECE]])
            if len(spaces):
                stop = stop + int(spaces[0])
                break
            stop += PIECE
            if stop >= len(data):
                stop = len(data)
                break
        cuts.append(stop)
        at = stop
    if at < len(data):
        cuts.append(len(data))
    return cuts


def word_hashes(
    data: np.ndarray, ends: np.ndarray, lower: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of white-space separated texts, and n + 1 word offsets."""
    hashes, starts, stops, at = [], [], [], 0
    for cut in _cuts(data):
        piece = data[at:cut]
        if lower:
            piece = ASCII_LOWER[piece]
        word = ~SPACE[piece]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = ends[(ends > at) & (ends < cut)] - at
        first[inner] = word[inner]
        begin = np.flatnonzero(first)
        if len(begin):
            last = word.copy()
            last[:-1] &= ~word[1:]
            last[inner - 1] = word[inner - 1]
            stop = np.flatnonzero(last) + 1
            tail = piece[begin[0] :]
            which = np.cumsum(first[begin[0] :]) - 1
            place = np.arange(begin[0], len(piece)) - begin[which]
            powers = _power_table(int((stop - begin).max()) + 1)
            place = np.minimum(place, len(powers) - 1)
            value = np.add.reduceat(_BYTE_CODES[tail] * powers[place], begin - begin[0])
            hashes.append(mixed(value + (stop - begin).astype(np.uint64) * _ODD))
            starts.append(begin + at)
            stops.append(stop + at)
        at = cut
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(ends), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(stops), np.searchsorted(start, ends)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words, by its first word; runs cross texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = _power_table(width + 2)
    for j in range(width):
        total += hashes[j : j + n] * factor[j + 1]
    return mixed(total + np.uint64(width))
