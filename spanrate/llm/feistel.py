"""PII: format-preserving Feistel pseudonyms.

Validated numbers, dates and addresses are replaced by others of the same format: a keyed Feistel
network permutes the values of each kind, so equal values have equal pseudonyms in every document,
whatever their punctuation, different values have different ones, and the key's owner can go back.

Kinds and what is validated: ``iban`` (mod 97), ``card`` (13 to 19 digits, Luhn), ``ssn`` (ranges),
``phone`` (+ and 8 to 15 digits), ``ip`` (octets), ``date`` (calendar, 1900 to 2099; the day is
permuted), ``email`` (letters and digits of the name), ``secret`` (letters and digits of values
after words like password, and access keys). A permuted value that fails its kind's check is
permuted again until it passes; the check holds for the first value, so this ends and stays one to
one.

Null text stays null with no spans. Texts are read whole. Repeated rows are handled alike. Only id
and text are read by ``pseudonyms``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrate.llm import textbytes
from spanrate.llm.work import send_package

ROUNDS = 10
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2100, 1, 1).toordinal() - FIRST_DAY

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()

#: Letters and digits permuted as one number; longer values go in linked blocks.
BLOCK = 512
#: 8 to 15 digits behind the plus, in groups of any size, one of them in brackets or none.
_NUMBER = "|".join(
    [
        rf"\d{{{c}}}[ .-]?\(\d{{{a}}}\)(?:[ .-]?\d){{{8 - c - a},{15 - c - a}}}"
        for c in (3, 2, 1)
        for a in (4, 3, 2, 1)
    ]
    + [r"\d(?:[ .-]?\d){7,14}"]
)

#: Kinds in the order in which they claim text.
PATTERNS = [
    ("secret", re.compile(r"\bAKIA([0-9A-Z]{16})\b")),
    (
        "secret",
        re.compile(
            r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
            r"([A-Za-z0-9_+/.\-]{6,})"
        ),
    ),
    ("email", re.compile(r"(?<![\w.+-])([A-Za-z0-9][\w.+-]*+)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("iban", re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("phone", re.compile(rf"(?<![\w+])(\+(?:{_NUMBER}))(?!\w)")),
    ("ip", re.compile(r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)")),
    ("date", re.compile(r"(?<![\w/.-])(\d{4}-\d{2}-\d{2}|\d{1,2}([/.])\d{1,2}\2\d{4})(?![\w/-]|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])(\d(?:[ -]?\d){12,18})(?![\w-])")),
]


class Feistel:
    """Keyed permutations of range(size)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, tweak: str, turn: int, value: int, size: int) -> int:
        said = f"{tweak}|{turn}|{value}".encode()
        width = size.bit_length() // 8 + 9
        raw = b""
        while len(raw) < width:
            raw += hashlib.blake2b(said + b"|%d" % len(raw), key=self.key, digest_size=64).digest()
        return int.from_bytes(raw[:width]) % size

    def permute(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """A balanced network over a rectangle that holds the range, walked until inside."""
        tall = max(1, math.isqrt(size - 1) + 1) if size > 1 else 1
        wide = -(-size // tall)
        sign = -1 if back else 1
        while True:
            left, right = divmod(value, wide)
            for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if turn % 2:
                    right = (right + sign * self._mix(tweak, turn, left, wide)) % wide
                else:
                    left = (left + sign * self._mix(tweak, turn, right, tall)) % tall
            value = left * wide + right
            if value < size:
                return value

    def walk(self, value: int, size: int, tweak: str, valid: Callable[[int], bool], back: bool) -> int:
        """Permute until the value is valid again."""
        while True:
            value = self.permute(value, size, tweak, back)
            if valid(value):
                return value

    def letters(self, text: str, tweak: str, back: bool = False) -> str:
        """Digits, small and capital letters permuted together, each within its kind.

        Values of more than ``BLOCK`` characters go in blocks, forwards and then backwards; each
        block's permutation is chosen by the blocks before it, so that all depend on all.
        """
        if len(text) <= BLOCK:
            return self._block(text, tweak, back)
        n = -(-len(text) // BLOCK)
        cuts = [len(text) * i // n for i in range(n + 1)]
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        ways = [("forth", range(n)), ("back", range(n - 1, -1, -1))]
        for way, order in reversed(ways) if back else ways:
            chain = f"{tweak}|{way}|{len(text)}".encode()
            for i in order:
                chain = hashlib.blake2b(chain, digest_size=16).digest()
                own = self._block(parts[i], f"{tweak}|{chain.hex()}", back)
                chain += (parts[i] if back else own).encode()
                parts[i] = own
        return "".join(parts)

    def _block(self, text: str, tweak: str, back: bool) -> str:
        kinds = [next((k for k in (DIGITS, LOWER, UPPER) if c in k), c) for c in text]
        size = math.prod(len(k) for k in kinds)
        value = 0
        for c, k in zip(text, kinds, strict=True):
            value = value * len(k) + k.index(c)
        shape = "".join(k[0] for k in kinds)
        value = self.permute(value, size, f"{tweak}|{shape}", back)
        out = []
        for k in reversed(kinds):
            value, at = divmod(value, len(k))
            out.append(k[at])
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _refill(shape: str, chars: str) -> str:
    """``chars`` in the places of the letters and digits of ``shape``."""
    rest = iter(chars)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def _card(f: Feistel, found: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", found)
    if luhn(digits) or digits[0] not in "3456" or len(set(digits)) == 1:
        return None
    n = len(digits) - 2

    def whole(value: int) -> str:
        body = digits[0] + f"{value:0{n}d}"
        return body + str(-luhn(body + "0") % 10)

    valid = lambda v: len(set(whole(v))) > 1
    return _refill(found, whole(f.walk(int(digits[1:-1]), 10**n, f"card{digits[0]}{n}", valid, back)))


def _iban(f: Feistel, found: str, back: bool) -> str | None:
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34 or mod97(plain) != 1 or not 2 <= int(plain[2:4]) <= 98:
        return None
    body = f.letters(plain[4:], f"iban{plain[:2]}", back)
    check = 98 - mod97(plain[:2] + "00" + body)
    return _refill(found, f"{plain[:2]}{check:02d}{body}")


def _ssn_ok(value: int) -> bool:
    area, group, serial = value // 1_000_000, value // 10_000 % 100, value % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(f: Feistel, found: str, back: bool) -> str | None:
    value = int(found.replace("-", ""))
    if not _ssn_ok(value):
        return None
    return _refill(found, f"{f.walk(value, 10**9, 'ssn', _ssn_ok, back):09d}")


def _phone(f: Feistel, found: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 8 <= len(digits) <= 15:
        return None
    country = 1 if digits[0] in "17" else 2
    n = len(digits) - country
    area = lambda v: f"{v:0{n}d}"[0] >= "2"
    was = area(int(digits[country:]))
    own = f.walk(int(digits[country:]), 10**n, f"phone{digits[:country]}{n}", lambda v: area(v) == was, back)
    return _refill(found, digits[:country] + f"{own:0{n}d}")


def _ip_kind(value: int) -> str:
    a, b = value >> 24, value >> 16 & 255
    if a == 10 or a == 172 and 16 <= b < 32 or (a, b) == (192, 168):
        return "private"
    return "special" if a in (0, 127) or a >= 224 else "public"


def _ip(f: Feistel, found: str, back: bool) -> str | None:
    octets = found.split(".")
    if any(int(x) > 255 or str(int(x)) != x for x in octets):
        return None
    value = int.from_bytes(bytes(map(int, octets)))
    kind = _ip_kind(value)
    own = f.walk(value, 2**32, "ip", lambda v: _ip_kind(v) == kind, back)
    return ".".join(map(str, own.to_bytes(4)))


def _date(f: Feistel, found: str, back: bool) -> str | None:
    parts = [int(x) for x in re.split(r"[-/.]", found)]
    orders = ["ymd"] if "-" in found else ["dmy", "mdy"]
    for order in orders:
        named = dict(zip(order, parts, strict=True))
        try:
            day = dt.date(named["y"], named["m"], named["d"]).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            continue
        # The order must still be told from the pseudonym: day first if that is a date.
        ambiguous = lambda v: dt.date.fromordinal(v + FIRST_DAY).day <= 12
        keep = (lambda v: True) if order != "mdy" else (lambda v: not ambiguous(v))
        own = dt.date.fromordinal(f.walk(day, DAYS, "date" if order != "mdy" else "late", keep, back) + FIRST_DAY)
        values = {"y": f"{own.year:04d}", "m": f"{own.month:02d}", "d": f"{own.day:02d}"}
        mark = found[4] if order == "ymd" else re.search(r"[/.]", found)[0]
        return mark.join(values[k] for k in order)
    return None


def _email(f: Feistel, found: str, back: bool) -> str | None:
    return f.letters(found, "email", back)


def _secret(f: Feistel, found: str, back: bool) -> str | None:
    return f.letters(found, "secret", back)


REPLACERS = {
    "secret": _secret,
    "email": _email,
    "iban": _iban,
    "phone": _phone,
    "ip": _ip,
    "date": _date,
    "ssn": _ssn,
    "card": _card,
}


def find_and_replace(f: Feistel, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms and the spans (kind, start, end) of the values in the given text."""
    has_digit = any(map(text.__contains__, DIGITS))
    spans: list[tuple[int, int, str, str]] = []  # sorted and apart from each other
    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        if kind not in ("email", "secret") and not has_digit:
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1)
            place = bisect_left(spans, (b,))  # of those that begin before b the last ends last
            if place and spans[place - 1][1] > a:
                continue
            own = REPLACERS[kind](f, m[1], back)
            if own is not None:
                spans.insert(place, (a, b, kind, own))
    out, at = [], 0
    for a, b, _, own in spans:
        out += [text[at:a], own]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in spans]


def _replacer(key: bytes):
    spans_type = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    )

    def replace(batches):
        f = Feistel(key)
        for block in textbytes.blocks(batches, "text"):
            texts, spans = [], []
            for text in block.column("text").to_pylist():
                own, found = (text, []) if text is None else find_and_replace(f, text)
                texts.append(own)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, spans_type)],
                names=["doc_id", "text", "spans"],
            )

    return replace


def pseudonyms(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, spans) per row: spans are (kind, start, end) in the text as given."""
    send_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _replacer(key),
        "doc_id long, text string, spans array<struct<kind:string,start:int,end:int>>",
    )
