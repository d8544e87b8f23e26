"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Every value that is found and validated is ranked in the set of all valid values of its format (card numbers
with a right check digit, days of a calendar, IPv4 addresses, ...), the rank is permuted within that set, and the
value at the new rank is written in the same layout. Equal values therefore get equal pseudonyms in every
document and run under one key, different values stay different, and the key holder can invert it. Dates are permuted
among those of one layout (order and widths of the fields), so one day in two layouts may become two days.

What the layout shows stays: the lengths of an address's name and domain, its last domain label, the place of capitals
and signs, a card's or account's length. IPv6 addresses, and local telephone numbers without an area code, aren't sought.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date", "secret")
KINDS_IN_ORDER = ("email", "secret", "iban", "date", "ip", "ssn", "card", "phone")
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of 0 .. size - 1 for any size: an unbalanced network over a grid just larger than
    ``size``, walked along its cycle until it is back inside."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.a = size, isqrt(max(size - 1, 0)) + 1
        self.b = -(-size // self.a)
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), f"{tweak}:{size}".encode()

    def _round(self, i: int, half: int, modulus: int) -> int:
        raw = hashlib.blake2b(b"%d:%d:" % (i, half) + self.tweak, key=self.key, digest_size=32).digest()
        return int.from_bytes(raw, "big") % modulus

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        sign = -1 if back else 1
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                right = (right + sign * self._round(i, left, self.b)) % self.b
            else:
                left = (left + sign * self._round(i, right, self.a)) % self.a
        return left * self.b + right

    def __call__(self, x: int, back: bool = False) -> int:
        if self.size < 2:
            return x
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x


def luhn_digit(payload: str) -> int:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


@lru_cache(10_000)
def letter_class(c: str, upper: bool) -> str:
    """The characters among which one is permuted: those of its kind in its 64 code points of Unicode, in lower case. If it is
    written ``upper``, only those that have one capital that leads back."""
    if c.isascii():
        return "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else "0123456789"
    kind = lambda x: (x.isalpha(), x.isdecimal(), x.isalnum())
    base = ord(c) & ~63
    same = (x for x in map(chr, range(base, base + 64)) if kind(x) == kind(c) and (x.lower() == x or len(x.lower()) > 1))
    return "".join(x for x in same if not upper or (len(x.upper()) == 1 and x.upper() != x and x.upper().lower() == x))


def _ranked(chars: list[str], classes: list[str]) -> tuple[int, int]:
    rank = size = 0
    size = 1
    for c, cls in zip(chars, classes, strict=True):
        rank, size = rank * len(cls) + cls.index(c), size * len(cls)
    return rank, size


def _unranked(rank: int, classes: list[str]) -> list[str]:
    out = []
    for cls in reversed(classes):
        rank, k = divmod(rank, len(cls))
        out.append(cls[k])
    return out[::-1]


class Pseudonyms:
    """Finds, validates and replaces the values of a text; ``back`` inverts."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.permute = lru_cache(100_000)(self._permute)
        # in this order: what one kind takes, no later kind sees
        parts = {
            "email": r"[\w][\w.%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,18}(?![\w-])",
            "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:(?<=token = \")|(?<=token=\")|(?<=token=)|(?<=password=)|(?<=secret=)|(?<=api_key=)|(?<=apikey=))[0-9A-Fa-f]{16,128}(?![A-Za-z0-9])",
            "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
            "date": r"(?<![\d./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![\d]|[./-]\d)",
            "ip": r"(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\d|\.\d)",
            "ssn": r"(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d]|-\d)",
            "card": r"(?<![\dA-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?![\dA-Za-z])",
            "phone": r"(?<![\w(])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?!\d)|(?<!\w)\+[1-9][0-9]?[0-9]?(?:[ .-]?[0-9]{2,4}){2,4}(?!\d)",
        }
        self.parts = {k: re.compile(v) for k, v in parts.items()}
        self.pattern = re.compile("|".join(self._named(k, v) for k, v in parts.items()))
        # cards in any other layout, sought in what all kinds leave
        self.loose = re.compile(r"(?<![\dA-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![\dA-Za-z])")

    @staticmethod
    def _named(kind: str, pattern: str) -> str:
        """The kind as a group, its back references by name, as groups are numbered across the whole alternation."""
        for n, group in (("1", "([-/.])"), ("2", "([-/.])"), ("1", "([ -])"), ("2", "([ -])")):
            if f"\\{n}" in pattern and group in pattern:
                pattern = pattern.replace(group, f"(?P<{kind}{n}>{group[1:]}", 1).replace(f"\\{n}", f"(?P={kind}{n})")
        return f"(?P<{kind}>{pattern})"

    def _permute(self, kind: str, rank: int, size: int) -> int:
        return Feistel(self.key, kind, size)(rank, self.back)

    def _letters(self, kind: str, value: str) -> str:
        """Letters and digits of a value permuted together, each within its class; case and the rest stay."""
        # capitals without a way back stand for themselves
        low = [c.lower() if len(c.lower()) == 1 and (c.lower().upper() == c or c.lower() == c) else c for c in value]
        at = [k for k, c in enumerate(low) if c.isalnum() and c in letter_class(c, c != value[k])]
        classes = [letter_class(low[k], low[k] != value[k]) for k in at]
        new = _unranked(self.permute(kind, *_ranked([low[k] for k in at], classes)), classes)
        out = list(value)
        for k, c in zip(at, new, strict=True):
            out[k] = c.upper() if value[k] != low[k] else c
        return "".join(out)

    @staticmethod
    def _fill(layout: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in layout)

    def email(self, v: str) -> str | None:
        body, _, tld = v.rpartition(".")
        return f"{self._letters('email', body)}.{tld}"

    def secret(self, v: str) -> str | None:
        if v.startswith("AKIA"):
            chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
            return "AKIA" + "".join(_unranked(self.permute("key", *_ranked(list(v[4:]), [chars] * 16)), [chars] * 16))
        # values without capitals, without small letters and with both are permuted among themselves, so each keeps its case and way back
        low, up = any(c in "abcdef" for c in v), any(c in "ABCDEF" for c in v)
        classes = ["0123456789" + "abcdef" * (low or not up) + "ABCDEF" * up] * len(v)
        rank, size = _ranked(list(v), classes)
        while True:
            rank = self.permute(f"hex{low and up:d}{up:d}", rank, size)
            new = "".join(_unranked(rank, classes))
            if not up or (any(c in "ABCDEF" for c in new) and (not low or any(c in "abcdef" for c in new))):
                return new

    def iban(self, v: str) -> str | None:
        plain = v.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        classes = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in plain[4:]]
        body = "".join(_unranked(self.permute("iban" + plain[:2], *_ranked(list(plain[4:]), classes)), classes))
        it = iter(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")
        return "".join(next(it) if c != " " else " " for c in v)

    def date(self, v: str) -> str | None:
        parts, sep = re.findall(r"\d+", v), re.search(r"\D", v)[0]
        # year first; or day first where that is a date, else month first
        for order in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
            got = dict(zip(order, map(int, parts), strict=True))
            width = {c: len(p) for c, p in zip(order, parts, strict=True)}
            try:
                rank = datetime.date(got["y"], got["m"], got["d"]).toordinal() - _DAY0
            except ValueError:
                continue
            if not 0 <= rank < _DAYS:
                return None
            while True:  # along the cycle to the next day that is written in this layout and read back from it
                rank = self.permute("date", rank, _DAYS)
                new = datetime.date.fromordinal(_DAY0 + rank)
                if all(width[c] == 2 or n < 10 for c, n in (("d", new.day), ("m", new.month))) and (order != "mdy" or new.day > 12):
                    return sep.join(f"{ {'y': new.year, 'm': new.month, 'd': new.day}[c]:0{width[c]}d}" for c in order)
        return None

    def ip(self, v: str) -> str | None:
        octets = v.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        rank = self.permute("ip", int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32)
        return ".".join(map(str, rank.to_bytes(4, "big")))

    def ssn(self, v: str) -> str | None:
        a, b, c = map(int, v.split("-"))
        areas = 898  # 001-899 without 666
        if not (0 < a < 900 and a != 666 and b and c):
            return None
        rank = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
        rank, c = divmod(self.permute("ssn", rank, areas * 99 * 9999), 9999)
        a, b = divmod(rank, 99)
        return f"{a + 1 + (a + 1 >= 666):03d}-{b + 1:02d}-{c + 1:04d}"

    def card(self, v: str) -> str | None:
        digits = re.sub(r"\D", "", v)
        if luhn_digit(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
            return None
        n = len(digits) - 1
        rank = first = int(digits[:-1])
        while True:  # a card in a free layout must not become one that holds a value of another kind
            rank = self.permute("card", rank, 10**n)
            new = self._fill(v, f"{rank:0{n}d}{luhn_digit(f'{rank:0{n}d}')}")
            if self.parts["card"].fullmatch(v) or not self._values(new):
                return new
            if rank == first:  # all of its cycle hold one: so does the value, which is then that value's
                return None

    def phone(self, v: str) -> str | None:
        digits = re.sub(r"\D", "", v)
        own = digits[1:] if v.startswith("+1") else digits
        if len(own) == 10 and (v.startswith("+1") or not v.startswith("+")):
            if own[0] < "2" or own[3] < "2":
                return None
            classes = ["23456789" if k in (0, 3) else "0123456789" for k in range(10)]
            new = "".join(_unranked(self.permute("phone", *_ranked(list(own), classes)), classes))
            return self._fill(v, digits[: len(digits) - 10] + new)
        if v.startswith("+") and 8 <= len(digits) <= 15:
            n = len(digits) - 1
            return self._fill(v, digits[0] + f"{self.permute('phone' + digits[0], int(digits[1:]), 10**n):0{n}d}")
        return None

    def _at(self, text: str, kind: str, at: int) -> tuple[int, str] | None:
        """The end and the pseudonym of the longest valid value of a kind that begins at ``at``. Only IBANs and
        telephone numbers have shorter forms; a telephone number must not end inside a value that follows it."""
        m = self.parts[kind].match(text, at)
        if m is None:
            return None
        shortest = at + 8 if kind in ("iban", "phone") else m.end()
        for end in range(m.end(), shortest - 1, -1):
            if end < m.end() and (not text[end - 1].isalnum() or text[end].isalnum() or not self.parts[kind].fullmatch(text, at, end)):
                continue
            got = getattr(self, kind)(text[at:end])
            if got is not None and not (kind == "phone" and text[at] == "+" and self._cuts(text, at, end)):
                return end, got
        return None

    def _cuts(self, text: str, at: int, end: int) -> bool:
        """Whether a valid value begins inside text[at:end] and ends behind it, and none begins right behind it."""

        def beyond(p: int) -> bool:
            found = ((kind, self.parts[kind].match(text, p)) for kind in ("date", "ip", "ssn", "card", "phone"))
            return any(m and m.end() > end and getattr(self, kind)(m[0]) is not None for kind, m in found)

        return not beyond(end + 1) and any(beyond(p) for p in range(at + 1, end) if text[p].isdigit() and not text[p - 1].isdigit())

    def _values(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the values, without cards in a free layout. Where a match isn't valid,
        shorter ones and the later kinds are tried at its place, and the search goes on behind its first character."""
        found, at = [], 0
        while m := self.pattern.search(text, at):
            at = m.start() + 1
            for kind in KINDS_IN_ORDER[KINDS_IN_ORDER.index(m.lastgroup) :]:
                if got := self._at(text, kind, m.start()):
                    found.append((m.start(), got[0], kind, got[1]))
                    at = got[0]
                    break
        return found

    def _loose_cards(self, text: str, at: int, end: int) -> list[tuple[int, int, str, str]]:
        """The cards in a free layout between two values, the longest that is valid at each place."""
        found = []
        while m := self.loose.search(text, at):
            at = m.start() + 1
            if m.start() >= end:
                break
            for to in range(min(m.end(), end), m.start() + 12, -1):
                if text[to - 1].isdigit() and not (text[to : to + 1].isascii() and text[to : to + 1].isalnum()) and self.loose.fullmatch(text, m.start(), to):
                    got = self.card(text[m.start() : to])
                    if got is not None:
                        found.append((m.start(), to, "card", got))
                        at = to
                        break
        return found

    def text(self, text: str) -> tuple[str, list[int]]:
        """The text with its values replaced, and the number replaced of each kind."""
        counts = dict.fromkeys(KINDS, 0)
        values = self._values(text)
        if values:
            gaps = zip([0, *(v[1] for v in values)], [*(v[0] for v in values), len(text)], strict=True)
        else:
            gaps = [(0, len(text))]
        loose = [v for a, b in gaps if b - a > 12 for v in self._loose_cards(text, a, b)]
        out, at = [], 0
        for start, end, kind, new in sorted(values + loose):
            out += [text[at:start], new]
            counts[kind] += 1
            at = end
        return "".join(out) + text[at:], list(counts.values())


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with personal values of ``text_col`` replaced, and a count ``n_<kind>`` for each of KINDS.

    Kinds: e-mail addresses, IBANs with a right checksum, card numbers with a right check digit, social security
    and telephone numbers in valid ranges, IPv4 addresses, calendar dates from 1900 to 2099, and access keys and
    hexadecimal secrets. Values that don't validate stay. Digits in a free layout (any single spaces and hyphens) are
    taken for a card last, where a check digit fits; inverting such a one beside further digits can fail by chance. Null text stays null with counts of 0; empty, repeated
    and very long texts are treated like any, and an empty table stays empty; other columns of any name pass through, but a
    column ``n_<kind>`` is replaced by the count. Only texts with a digit or an @ reach Python.
    """
    fields = ", ".join(f"n_{k}: long" for k in KINDS)

    @F.pandas_udf(f"struct<clean: string, {fields}>")
    def replace(texts: pd.Series) -> pd.DataFrame:
        names = Pseudonyms(key.encode(), back)
        rows = [(None, *[0] * len(KINDS)) if t is None or t is pd.NA else (lambda r: (r[0], *r[1]))(names.text(t)) for t in texts]
        return pd.DataFrame(rows, columns=["clean", *[f"n_{k}" for k in KINDS]])

    text, found = F.col(text_col).cast("string"), spare(docs, "privacy_found")
    got = docs.withColumn(found, replace(F.when(text.rlike("[0-9@]"), text)))
    names = [f"n_{k}" for k in KINDS]
    kept = [F.coalesce(F.col(found)["clean"], text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in names]
    return got.select(*kept, *[F.coalesce(F.col(found)[c], F.lit(0).cast("long")).alias(c) for c in names])
