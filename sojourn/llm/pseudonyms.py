"""Personal data: numbers, dates and mail names become pseudonyms of the same format by a keyed permutation.

A value that passes its kind's validation is one of N values of its format. A Feistel network on that range
(with cycle walking, Black and Rogaway, 2002) maps it to another of them: check digits hold, dates exist, and
equal values get equal pseudonyms in all documents. With the key the permutation can be inverted.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sojourn.llm.common import prepare, text_slices

ROUNDS = 8


class Feistel:
    """A keyed permutation of 0, ..., size - 1; `tweak` tells kinds of values apart."""

    def __init__(self, key: bytes, size: int, tweak: str):
        self.size, self.left = size, max(1, math.isqrt(max(size - 1, 0)) + 1)
        self.right = -(-size // self.left)
        self.key = hashlib.blake2b(key + tweak.encode(), digest_size=32).digest()

    def _round(self, i: int, value: int) -> int:
        data = i.to_bytes(1, "big") + value.to_bytes(max(1, -(-value.bit_length() // 8)), "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=48).digest(), "big")

    def _once(self, value: int, rounds: range, sign: int) -> int:
        a, b = value % self.left, value // self.left
        for i in rounds:
            if i % 2:
                b = (b + sign * self._round(i, a)) % self.right
            else:
                a = (a + sign * self._round(i, b)) % self.left
        return a + self.left * b

    def __call__(self, value: int) -> int:
        value = self._once(value, range(ROUNDS), 1)
        while value >= self.size:
            value = self._once(value, range(ROUNDS), 1)
        return value

    def inverse(self, value: int) -> int:
        value = self._once(value, range(ROUNDS - 1, -1, -1), -1)
        while value >= self.size:
            value = self._once(value, range(ROUNDS - 1, -1, -1), -1)
        return value


Permute = Callable[[int, int, str], int]  # value, size, tweak


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def luhn_check(digits: str) -> int:
    """The digit that completes the given ones to a valid card number."""
    doubled = (int(c) * (2 - i % 2) for i, c in enumerate(reversed(digits)))
    return -sum(x // 10 + x % 10 for x in doubled) % 10


def _card(text: str, permute: Permute) -> str | None:
    digits = _digits(text)
    body = digits[:-1]
    if luhn_check(body) != int(digits[-1]) or not int(digits):
        return None
    body = f"{permute(int(body), 10 ** len(body), f'card{len(body)}'):0{len(body)}d}"
    return _refill(text, body + str(luhn_check(body)))


def _phone(text: str, permute: Permute) -> str | None:
    digits = _digits(text)
    country, local = digits[:-10], digits[-10:]
    return _refill(text, f"{country}{permute(int(local), 10**10, 'phone'):010d}")


def _social(text: str, permute: Permute) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    place = permute(place, 898 * 99 * 9999, "social")
    place, serial = divmod(place, 9999)
    area, group = divmod(place, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _address(text: str, permute: Permute) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "address")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _iban(text: str, permute: Permute) -> str | None:
    def check(country: str, body: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97

    plain = text.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if f"{check(country, body):02d}" != plain[2:4]:
        return None
    digits = _digits(body)
    if digits:
        body = _refill(body, f"{permute(int(digits), 10 ** len(digits), f'iban{len(digits)}'):0{len(digits)}d}")
    new = iter(f"{country}{check(country, body):02d}{body}")
    return "".join(" " if c == " " else next(new) for c in text)


_FIRST, _LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def _date(text: str, permute: Permute) -> str | None:
    numbers = [int(x) for x in re.split(r"[-./]", text)]
    if text[4] == "-":
        shape, (year, month, day) = "{0:04d}-{1:02d}-{2:02d}", numbers
    elif text[2] == ".":
        shape, (day, month, year) = "{2:02d}.{1:02d}.{0:04d}", numbers
    else:
        shape, (month, day, year) = "{1:02d}/{2:02d}/{0:04d}", numbers
    try:
        date = dt.date(year, month, day)
    except ValueError:
        return None
    if not _FIRST <= date <= _LAST:
        return None
    date = _FIRST + dt.timedelta(permute((date - _FIRST).days, (_LAST - _FIRST).days + 1, "date"))
    return shape.format(date.year, date.month, date.day)


def _mail(text: str, permute: Permute) -> str | None:
    """Letters and digits of the name change within their kind; the rest and the domain stay."""
    name, domain = text.rsplit("@", 1)
    value, size, places = 0, 1, []
    for c in name:
        base = 26 if c.isascii() and c.isalpha() else 10 if c.isdigit() else 0
        places.append(base)
        if base:
            value = value * base + (ord(c.lower()) - 97 if base == 26 else int(c))
            size *= base
    value = permute(value, size, f"mail{places}")
    out = []
    for c, base in zip(reversed(name), reversed(places)):
        if base:
            value, digit = divmod(value, base)
            c = chr(digit + (65 if c.isupper() else 97)) if base == 26 else str(digit)
        out.append(c)
    return "".join(reversed(out)) + "@" + domain


#: The kinds of values, in the order in which they are looked for at a place.
KINDS: dict[str, tuple[str, Callable[[str, Permute], str | None]]] = {
    "mail": (r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}", _mail),
    "iban": (r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "date": (r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])", _date),
    "address": (r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", _address),
    "social": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])", _social),
    "phone": (
        r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
        r"|\+[0-9]{1,3}[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
        _phone,
    ),
    "card": (r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _card),
}
_PATTERNS = {kind: re.compile(rf"(?<![A-Za-z0-9]){pattern}") for kind, (pattern, _) in KINDS.items()}


_DIGIT_RUN, _DIGIT_GROUP = re.compile(r"[0-9]+(?:[ -][0-9]+)*"), re.compile("[0-9]+")
#: Lengths of the groups of a card number, the usual ones first. One group of 13 to 19 digits comes before them.
_CARD_SHAPES = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 3, 3, 3), (4, 4, 5), (4, 4, 4, 3), (8, 8), (6, 13), (2,) * 8]
_CARD_PREFIX = re.compile("2[2-7]|[3-6]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
#: Characters of a country's IBAN.
_IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _card_spans(text: str) -> Iterator[tuple[int, int]]:
    """Where a card may be, the likeliest of each run of digits first; a span consists of whole groups of digits."""
    for run in _DIGIT_RUN.finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [m.span() for m in _DIGIT_GROUP.finditer(text, *run.span())]
        sizes = [end - begin for begin, end in groups]
        spans = []
        for i, (begin, end) in enumerate(groups):
            if not i and begin and text[begin - 1].isascii() and text[begin - 1].isalpha():
                continue
            likely = _CARD_PREFIX.match(text, begin) is not None
            if 13 <= sizes[i] <= 19:
                spans.append((-1, not likely, begin, end))
            for rank, shape in enumerate(_CARD_SHAPES):
                if tuple(sizes[i : i + len(shape)]) == shape:
                    spans.append((rank, not likely, begin, groups[i + len(shape) - 1][1]))
        yield from (span[2:] for span in sorted(spans))
        # any other grouping, from the run's begin on
        yield from (m.span() for m in _PATTERNS["card"].finditer(text, run.start(), run.end()))


def _iban_spans(text: str) -> list[tuple[int, int]]:
    """Where an IBAN may be: at first those of their country's length, then all others, the longest first."""
    spans = []
    for head in _IBAN_HEAD.finditer(text):
        begin, length, at = head.start(), 4, head.end()
        own = _IBAN_LENGTHS.get(text[begin : begin + 2])
        while at < len(text) and length < 35:
            if text[at] == " " and not length % 4:
                at += 1
            if not re.match("[A-Z0-9]", text[at : at + 1]):
                break
            length, at = length + 1, at + 1
            if length >= 12 and not re.match("[A-Za-z0-9]", text[at : at + 1]):
                spans.append((length != own, begin, -at))
    return [(begin, -end) for _, begin, end in sorted(spans)]


def _without_overlap(found: list[tuple[int, int, int, str, str]]) -> list[tuple[int, int, int, str, str]]:
    """Of overlapping (begin, rank, end, ...) the one that begins first, of those the least rank."""
    kept = []
    for value in sorted(found):
        if not kept or value[0] >= kept[-1][2]:
            kept.append(value)
    return kept


def pseudonymised(text: str, permute: Permute) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, begin, end) of each value in the text that was given.

    Of overlapping values the one that begins first counts, of those the first kind. A card or an IBAN may have
    other numbers or words on both sides.
    """
    found = []
    for rank, (kind, pattern) in enumerate(_PATTERNS.items()):
        used: set[int] = set()
        begins = []
        if kind == "iban":
            spans = _iban_spans(text)
        elif kind == "card":  # not of digits of other values
            found = _without_overlap(found)
            begins, spans = [f[0] for f in found], _card_spans(text)
        else:
            spans = (m.span() for m in pattern.finditer(text))
        for begin, end in spans:
            before = bisect_right(begins, begin)
            if not used.isdisjoint(range(begin, end)) or before and found[before - 1][2] > begin:
                continue
            new = KINDS[kind][1](text[begin:end], permute)
            if new is not None:
                used.update(range(begin, end))
                found.append((begin, rank, end, kind, new))
    out, at = [], 0
    kept = _without_overlap(found)
    for begin, _, end, _, new in kept:
        out += [text[at:begin], new]
        at = end
    return "".join([*out, text[at:]]), [(kind, begin, end) for begin, _, end, kind, _ in kept]


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of `docs` that hold personal data: doc_id, text with pseudonyms, and `found`.

    `found` lists kind, begin and end (characters of the given text) of each replaced value. A value that fails
    its validation (check digits, calendar, number ranges) stays, as do texts without values; those rows, null
    and empty texts are left out, so `docs` minus these ids is unchanged.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    entry = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        networks: dict[tuple[int, str], Feistel] = {}

        def permute(value: int, size: int, tweak: str) -> int:
            if (size, tweak) not in networks:
                if len(networks) > 10_000:
                    networks.clear()
                networks[size, tweak] = Feistel(key, size, tweak)
            return networks[size, tweak](value)

        for part, texts in text_slices(batches):
            maybe = pc.match_substring_regex(texts, "[0-9@]")
            ids, changed, places = [], [], []
            for doc_id, text in zip(part.column("doc_id").filter(maybe), texts.filter(maybe).to_pylist()):
                new, found = pseudonymised(text, permute)
                if found:
                    ids.append(doc_id.as_py())
                    changed.append(new)
                    places.append([dict(zip(("kind", "begin", "end"), f)) for f in found])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, part.column("doc_id").type),
                    pa.array(changed, pa.string()),
                    pa.array(places, pa.list_(entry)),
                ],
                names=["doc_id", "text", "found"],
            )

    schema = f"doc_id {kind}, text string, found array<struct<kind: string, begin: int, end: int>>"
    return docs.select("doc_id", "text").mapInArrow(replace, schema)
