"""Format-preserving Feistel pseudonyms for personal data (operator 8).

Numbers and dates that pass their format's validation are permuted, under a key, among the values of that format: a
payment card becomes another card with a right check digit, a date another date in the same layout, a phone number one of the
same country. The permutation is a balanced Feistel network over the number of values of the format, walked on until it
falls inside; so equal values have equal pseudonyms in all documents, different ones different, and whoever holds the key
can invert them. The key has no default.

Formats, in ASCII digits and letters, not inside longer words or numbers:

- card: 13 to 19 digits with a right Luhn digit, whole or in groups of four (or 4-6-5) between spaces or hyphens;
- phone: ``+`` and 8 to 15 digits in groups between spaces, dots or hyphens, and ``(ddd) ddd-dddd``, ``ddd-ddd-dddd``, ``ddd.ddd.dddd`` whose area code
  and exchange begin with 2 to 9, which have the pseudonym of the same +1 number (+1 numbers outside that plan are permuted among such);
- date: ``2021-02-28``, ``28.02.2021``, ``02/28/2021`` with equal marks ``-/.`` and all zeros, ``3 March 1990``, ``March 3, 1990``, from 1900 to 2099;
- ip: IPv4; ssn: ``ddd-dd-dddd`` and ``ddd dd dddd`` in the numbers that are given out; iban: mod 97; key: ``AKIA`` and 16 letters or digits;
- email: its local part.

Not found: IPv6, digits other than ASCII, dates with single digits such as ``2021-3-4`` or abbreviated months, numbers spelled out.

Defined results: null stays null, empty stays empty; text outside matches is unchanged, as is what fails validation. Length
in characters changes only for ip and dates with named months. Null and repeated ids are kept as they are. An empty table gives no rows.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._session import attach

ROUNDS = 8


def permute(value: int, size: int, tweak: str, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 to size - 1: a Feistel network over the next even number of bits, repeated until it falls inside."""
    if size < 2:
        return value
    half = max(1, (max(1, (size - 1).bit_length()) + 1) // 2)
    mask = (1 << half) - 1
    head = tweak.encode()

    def f(i: int, x: int) -> int:
        h = hashlib.blake2b(head + bytes([i]) + x.to_bytes((half + 7) // 8, "big"), key=key[:64], digest_size=(half + 7) // 8)
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        a, b = value >> half, value & mask
        for i in range(ROUNDS):
            a, b = (b, a ^ f(i, b)) if not back else (b ^ f(ROUNDS - 1 - i, a), a)
        value = a << half | b
        if value < size:
            return value


def mixed_radix(digits: list[int], radices: list[int], tweak: str, key: bytes, back: bool = False) -> list[int]:
    value, size = 0, 1
    for d, r in zip(digits, radices, strict=True):
        value, size = value * r + d, size * r
    value, out = permute(value, size, tweak, key, back), []
    for r in reversed(radices):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


_CLASSES = {c: alphabet for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in alphabet}


def _by_class(text: str, tweak: str, key: bytes, back: bool) -> str:
    """Digits become digits and letters letters of the same case; all else stays."""
    at = [i for i, c in enumerate(text) if c in _CLASSES]
    moved = mixed_radix([_CLASSES[text[i]].index(text[i]) for i in at], [len(_CLASSES[text[i]]) for i in at], tweak + "|" + "".join("." if c in _CLASSES else c for c in text), key, back)
    out = list(text)
    for i, d in zip(at, moved, strict=True):
        out[i] = _CLASSES[text[i]][d]
    return "".join(out)


def _refill(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced in turn."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in layout)


def _only(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def card(text: str, key: bytes, back: bool) -> str | None:
    digits = _only(text)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = digits[1:-1]
    moved = digits[0] + str(permute(int(body), 10 ** len(body), f"card{digits[0]}", key, back)).zfill(len(body))
    return _refill(text, moved + str(luhn(moved)))


def _in_plan(digits: str) -> bool:
    """Whether area code and exchange of a +1 number begin with 2 to 9, as its plan asks."""
    return digits[1] not in "01" and digits[4] not in "01"


def phone(text: str, key: bytes, back: bool) -> str | None:
    digits = _only(text)
    if text[0] != "+":  # the same number with its country
        if not _in_plan("1" + digits):
            return None
        return _refill(text, _only(phone("+1" + digits, key, back))[1:])
    if not 8 <= len(digits) <= 15 or digits[0] == "0":
        return None
    if digits[0] == "1":
        if len(digits) != 11:
            return None
        if not _in_plan(digits):  # a second domain: the walk goes on until it is outside the plan again
            while True:
                digits = "1" + str(permute(int(digits[1:]), 10**10, "phone1 outside the plan", key, back)).zfill(10)
                if not _in_plan(digits):
                    return _refill(text, digits)
        radices, low = [8, 10, 10, 8] + [10] * 6, [2, 0, 0, 2] + [0] * 6
        moved = mixed_radix([int(c) - b for c, b in zip(digits[1:], low, strict=True)], radices, "phone1", key, back)
        return _refill(text, "1" + "".join(str(d + b) for d, b in zip(moved, low, strict=True)))
    body = digits[2:]
    return _refill(text, digits[:2] + str(permute(int(body), 10 ** len(body), f"phone{digits[:2]}", key, back)).zfill(len(body)))


def ip(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in parts) or parts[0] == "0":
        return None
    moved = mixed_radix([int(parts[0]) - 1, *map(int, parts[1:])], [255, 256, 256, 256], "ip", key, back)
    return ".".join(map(str, [moved[0] + 1, *moved[1:]]))


def ssn(text: str, key: bytes, back: bool) -> str | None:
    mark = text[3]
    a, g, s = map(int, text.split(mark))
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    a, g, s = mixed_radix([a - 1 - (a > 666), g - 1, s - 1], [898, 99, 9999], "ssn", key, back)
    return f"{a + 1 + (a >= 665):03d}{mark}{g + 1:02d}{mark}{s + 1:04d}"


FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _layout(text: str) -> tuple[str, datetime.date] | None:
    """Which of year-month-day, day-month-year or (where that is no date) month-day-year a text is."""
    a, b, c = map(int, re.split(r"[-/.]", text))
    for name, (y, m, d) in {"ymd": (a, b, c)}.items() if text[:4].isdigit() else {"dmy": (c, b, a), "mdy": (c, a, b)}.items():
        try:
            day = datetime.date(y, m, d)
        except ValueError:
            continue
        if 0 <= day.toordinal() - FIRST_DAY < DAYS:
            return name, day
    return None


#: Names of months.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _named_date(text: str, key: bytes, back: bool) -> str | None:
    a, b, year = text.replace(",", "").split(" ")
    day, month = (b, a) if a in MONTHS else (a, b)
    try:
        value = datetime.date(int(year), MONTHS.index(month) + 1, int(day)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= value < DAYS:
        return None
    moved = datetime.date.fromordinal(FIRST_DAY + permute(value, DAYS, "date", key, back))
    name = MONTHS[moved.month - 1]
    return f"{name} {moved.day}, {moved.year}" if a in MONTHS else f"{moved.day} {name} {moved.year}"


def date(text: str, key: bytes, back: bool) -> str | None:
    if " " in text:
        return _named_date(text, key, back)
    marks = re.findall(r"[-/.]", text)
    if marks[0] != marks[1] or not (found := _layout(text)):
        return None
    name, day = found
    value = day.toordinal() - FIRST_DAY
    while True:
        value = permute(value, DAYS, "date", key, back)
        day = datetime.date.fromordinal(FIRST_DAY + value)
        if name != "mdy" or day.day > 12:  # else it would be read as day-month-year
            return marks[0].join({"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}[x] for x in name)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(text: str, key: bytes, back: bool) -> str | None:
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = _by_class(flat[4:], f"iban{flat[:2]}", key, back)
    left = iter(flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(left) for c in text)


def key_(text: str, key: bytes, back: bool) -> str | None:
    return text[:4] + _by_class(text[4:], "key", key, back)


def email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.partition("@")
    return _by_class(local, f"email{domain.lower()}", key, back) + "@" + domain


KINDS = {"phone": phone, "date": date, "ip": ip, "ssn": ssn, "card": card, "iban": iban, "key": key_, "email": email}
NUMBERS = re.compile(
    r"(?<![\w.])(?:(?P<phone>\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+[1-9]\d{0,2}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})"
    r"|(?P<date>\d{4}([-/.])\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4}|[1-9]\d? (?:{months}) \d{4}|(?:{months}) [1-9]\d?, \d{4})|(?P<ip>\d{1,3}(?:\.\d{1,3}){3}(?!\.\d))|(?P<ssn>\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})|(?P<card>\d{13,19}|\d{4}([ -])\d{4}\7\d{4}\7\d{1,7}|\d{4}([ -])\d{6}\8\d{5})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)|(?P<key>AKIA[A-Z0-9]{16}))(?!\w)".replace("{months}", "|".join(MONTHS)),
    re.ASCII,
)
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+", re.ASCII)


@functools.lru_cache(100_000)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """What takes the place of ``text``, or None where it isn't a whole valid value. ``back`` inverts."""
    if kind != "email" and not ((m := NUMBERS.fullmatch(text)) and m.lastgroup == kind):
        return None
    return KINDS[kind](text, key, back)


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, Counter]:
    """The text with its valid values replaced, and how many of each kind."""
    found: Counter = Counter()

    parts, at = [], 0
    while m := NUMBERS.search(text, at):
        kind, own, begin = m.lastgroup, m[0], m.start()
        # Numbers that stand side by side can look like one: the longest valid head counts, and the search goes on behind it.
        cuts = [len(own), *sorted((i for i, c in enumerate(own) if c in " -"), reverse=True)]
        cut, new = next(((i, x) for i in cuts if (x := pseudonym(kind, own[:i], key, back)) is not None), (0, None))
        if new is None:
            cut = own.index(" ") if " " in own else len(own)
            new = own[:cut]
        else:
            found[kind] += 1
        parts += [text[at:begin], new]
        at = begin + cut
    out = "".join([*parts, text[at:]])
    if "@" in out:

        def mail(m: re.Match) -> str:
            found["email"] += 1
            return pseudonym("email", m[0], key, back)

        out = EMAIL.sub(mail, out)
    return out, +found


def replaced(key: bytes):
    """A column function of texts: a struct of text, n_found and found (kinds with their counts, in alphabetical order)."""
    if not key:
        raise ValueError("pseudonyms need a secret key")

    @F.pandas_udf("text string, n_found long, found string")
    def pseudonyms(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, Counter()) if x is None else replace(x, key) for x in texts]
        return pd.DataFrame({"text": [t for t, _ in rows], "n_found": [sum(c.values()) for _, c in rows], "found": [",".join(f"{k}:{n}" for k, n in sorted(c.items())) for _, c in rows]})

    return pseudonyms


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with pseudonyms, n_found, found."""
    attach(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), replaced(key)(docs[text_col].cast("string")).alias("r")).select("doc_id", "r.*")
