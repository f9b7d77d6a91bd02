"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Values that pass validation are mapped to another value of the same format: card
numbers with a right check digit; calendar dates (year first, day first or, where
the day is above 12, month first); telephone numbers (groups of three, three and
four digits; international ones of 8 to 15 digits behind a plus sign; ten digits
behind a word for telephone), which are valid unless all digits are equal; IPv4 and
IPv6 addresses (shortened ones, too, where a decimal digit or eight hexadecimal ones are written; of one that ends in IPv4 form, that end); bank account numbers with right check digits; e-mail addresses, the
last label of whose domain stays. The value is a number below the size of its
format, two halves of which are mixed in ROUNDS keyed rounds, repeated while the
result lies outside. The map is a permutation under the key, so equal values stay
linked across documents, different ones stay apart, and the owner of the key can go
back. The key is an argument; the query takes the session's setting KEY, or else a
random one for the session: no key is in this file.

Defined results: null texts stay null, empty ones empty; what fails validation
stays as it is, and the search goes on one character after its start (so a card
behind another group of four digits is found; on the way back such a group and the
new digits may form a valid number by chance, and then that text isn't restored);
account numbers in groups of four end at their country's length; a value is never
mapped twice: of kinds that begin at one place the first in KINDS wins, and of
overlapping ones the first to begin. Null ids, extra columns and repeated rows pass
through; very long texts are read whole.
"""
from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import math
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach, table
from .shared import slices

ROUNDS, KNOWN = 10, 100_000
KEY = "spark.quillspark.pii.key"
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("email", "iban", "date", "phone", "ip", "ip6", "card")
FOUND = regex.compile(
    r"(?<email>(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
    r"|(?<date>(?<!\d)(?:\d{4}(?:-\d{2}-|/\d{2}/|\.\d{2}\.)\d{2}|\d{2}(?:-\d{2}-|/\d{2}/|\.\d{2}\.)\d{4})(?!\d))"
    r"|(?<phone>(?<![\d(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<!\d)\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\+\d{8,15}(?!\d)"
    r"|(?<=\b(?i:tel|phone|telephone|mobile|fax|call)[.:]? {0,2})\d{10}(?!\d))"
    r"|(?<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){1,7}(?:::)?|[0-9A-Fa-f]{1,4}::|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?!\w|:[\w:]|\.\d))"
    r"|(?<card>(?<!\d)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)|(?<!\d)\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|(?<!\d)\d{13,19}(?!\d))"
)
# The countries of each length of an account number, which tells where one in groups of four ends.
COUNTRIES = {
    15: ("NO",),
    16: ("BE",),
    18: ("DK", "FI", "FO", "GL", "NL", "SD"),
    19: ("MK", "SI"),
    20: ("AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"),
    21: ("CH", "CR", "HR", "LI", "LV"),
    22: ("BG", "BH", "DE", "GB", "GE", "IE", "ME", "RS", "VA"),
    23: ("AE", "GI", "IL", "IQ", "OM", "SO", "TL"),
    24: ("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"),
    25: ("LY", "PT", "ST"),
    26: ("IS", "TR"),
    27: ("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"),
    28: ("AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "NI", "PL", "SV"),
    29: ("BR", "EG", "PS", "QA", "UA"),
    30: ("JO", "KW", "MU"),
    31: ("MT", "SC"),
    32: ("LC",),
    33: ("RU",),
}
LENGTHS = {c: n for n, countries in COUNTRIES.items() for c in countries}

MAY = regex.compile(r"[0-9@:]|\p{Nd}").search  # every kind has a digit, an at sign or a colon


def permuted(value: int, size: int, secret: bytes, tag: str, back: bool = False) -> int:
    """The keyed permutation of range(size): a Feistel network over two halves, walked until inside."""
    if size < 2:
        return value
    b = math.isqrt(size - 1) + 1
    a = -(-size // b)
    width = (max(a, b).bit_length() + 7) // 8

    def mix(turn: int, x: int, modulus: int) -> int:
        h = hashlib.blake2b(x.to_bytes(width, "big"), key=secret[:64], digest_size=width + 8, person=f"{tag[:12]}{turn:02}".encode()).digest()
        return int.from_bytes(h, "big") % modulus

    while True:
        left, right = divmod(value, b)
        for turn in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * mix(turn, left, b)) % b
            else:
                left = (left + sign * mix(turn, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def refilled(shape: str, symbols: str) -> str:
    """shape with its letters and digits replaced in order."""
    rest = iter(symbols)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def letters(value: str, secret: bytes, tag: str, back: bool, radix: int = 26) -> str:
    """Letters to letters of the same case, the first of the alphabet if radix is less, and digits to digits."""
    core = [c for c in value if c.isalnum()]
    sizes = [10 if c.isdigit() else radix for c in core]
    number = 0
    for c, r in zip(core, sizes):
        number = number * r + (int(c) if c.isdigit() else ord(c.lower()) - 97)
    number = permuted(number, math.prod(sizes), secret, tag + str(len(core)), back)
    made = []
    for c, r in zip(reversed(core), reversed(sizes)):
        number, d = divmod(number, r)
        made.append(str(d) if c.isdigit() else chr(d + (65 if c.isupper() else 97)))
    return refilled(value, "".join(reversed(made)))


@lru_cache(1)
def late_days() -> list[int]:
    """The days of the calendar above the twelfth of a month, which no month can be read as."""
    return [d for d in range(FIRST, LAST + 1) if datetime.date.fromordinal(d).day > 12]


def moved_date(value: str, secret: bytes, back: bool) -> str | None:
    """Year first; else day first; else month first, among the days that cannot be a month."""
    sign = value[4] if not value[4].isdigit() else value[2]
    y, m, d = value.split(sign) if len(value.split(sign)[0]) == 4 else reversed(value.split(sign))
    swapped = len(value.split(sign)[0]) == 2 and int(m) > 12
    if swapped:
        m, d = d, m
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    if not FIRST <= day <= LAST:
        return None
    if swapped:
        days = late_days()
        new = datetime.date.fromordinal(days[permuted(bisect.bisect_left(days, day), len(days), secret, "late", back)])
        return new.strftime(f"%m{sign}%d{sign}%Y")
    new = datetime.date.fromordinal(FIRST + permuted(day - FIRST, LAST - FIRST + 1, secret, "date", back))
    return new.strftime(f"%Y{sign}%m{sign}%d" if value[4] == sign else f"%d{sign}%m{sign}%Y")


def moved_phone(value: str, secret: bytes, back: bool) -> str | None:
    """All digits but the country's: what is written apart behind the plus sign, or two digits."""
    digits = "".join(c for c in value if c.isdigit())
    if len(set(digits)) < 2 or value[0] == "+" and not 8 <= len(digits) <= 15:
        return None
    country = 0
    if value[0] == "+":
        country = len(regex.match(r"\+(\d{1,3}(?!\d)|\d{2})", value)[1])
    n = len(digits) - country
    return refilled(value, digits[:country] + f"{permuted(int(digits[country:]), 10**n, secret, f'phone{n}', back):0{n}}")


def moved_ip6(value: str, secret: bytes, back: bool) -> str | None:
    """Hexadecimal digits in their places, letters to letters, so that the address stays one."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    written = [c for c in value if c != ":"]
    return letters(value, secret, "ip6", back, 6) if len(written) >= 8 or any(c.isdigit() for c in written) else None


def pseudonym(kind: str, value: str, secret: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or None where it fails validation."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "email":
        local, _, domain = value.partition("@")
        if not any(c.isalnum() for c in local):
            return None
        name, dot, last = domain.rpartition(".")
        return f"{letters(local, secret, 'email', back)}@{letters(name, secret, 'domain', back)}{dot}{last}"
    if kind == "iban":
        if iban_rest(value.replace(" ", "")) != 1:
            return None
        body = letters(value[4:], secret, "iban", back)
        return f"{value[:2]}{98 - iban_rest(value[:2] + '00' + body.replace(' ', '')):02}{body}"
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]):
            return None
        n = len(digits) - 1
        body = f"{permuted(int(digits[:-1]), 10**n, secret, f'card{n}', back):0{n}}"
        return refilled(value, body + str(luhn(body)))
    if kind == "date":
        return moved_date(value, secret, back)
    if kind == "phone":
        return moved_phone(value, secret, back)
    if kind == "ip6":
        return moved_ip6(value, secret, back)
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255:
        return None
    number = int.from_bytes(bytes(parts), "big")
    return ".".join(map(str, permuted(number, 1 << 32, secret, "ip", back).to_bytes(4, "big")))


def grouped(value: str) -> str:
    """The account number at the start of groups of four, or nothing where no group ends at its country's length."""
    n, seen = LENGTHS.get(value[:2], 0), 0
    for i, c in enumerate(value):
        seen += c != " "
        if seen == n:
            return value[: i + 1] if value[i + 1 : i + 2] in ("", " ") else ""
    return ""


def replaced(text: str, secret: bytes, counts: dict[str, int], back: bool = False, known: dict[tuple[str, str], str | None] | None = None) -> str:
    """The text with pseudonyms; known holds those of values that were met before."""
    known = {} if known is None else known
    made, done, at = [], 0, 0
    while m := FOUND.search(text, at):
        kind, value = m.lastgroup, m[0]
        if kind == "iban" and " " in value:
            value = grouped(value)
        if (kind, value) not in known:
            if len(known) >= KNOWN:
                known.clear()
            known[kind, value] = pseudonym(kind, value, secret, back) if value else None
        new = known[kind, value]
        if new is None:
            at = m.start() + 1  # what starts inside a failed match is tried too
            continue
        counts[kind] += 1
        made += [text[done : m.start()], new]
        done = at = m.start() + len(value)
    return "".join(made) + text[done:]


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """(doc_id, text with pseudonyms, n_<kind> for each kind)."""
    names = [f"n_{k}" for k in KINDS]
    keyed = secret.encode()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str | None] = {}  # clear values: they go with the task
        for b in slices(batches):
            texts, counts = [], []
            for t in b.column(1).to_pylist():
                by = dict.fromkeys(KINDS, 0)
                texts.append(replaced(t, keyed, by, back, known) if t and MAY(t) else t)
                counts.append(by)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS)], ["doc_id", "text", *names])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms, under the session's key."""
    attach(spark)
    if not spark.conf.get(KEY, ""):
        spark.conf.set(KEY, secrets.token_hex(32))
    return pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(KEY))


QUERIES = {"op3_pii": op3_pii}
ORACLE_SQL: dict[str, str] = {}
