"""Salary columns: ranges in free text and in structured fields."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

#: The type, and the amount pattern.
SALARY_TYPE = "struct<min: double, max: double, raw: string>"
_AMOUNT = r"(?:\$|€|£)\s*(\d+(?:,\d{3})*)\s*(k|K)?(?:\s*(?:-|–|—|to)\s*(?:\$|€|£)?\s*(\d+(?:,\d{3})*)\s*(k|K)?)?"


def extract_salary(text: Column) -> Column:
    """struct(min, max, raw) of the longest amount that looks annual, the first of equals; null fields if none.

    An amount looks annual if it or the 30 characters from its start hold a k, 'annual', 'year' or 'yr', or if its
    minimum is 50 or more. Euros and pounds are not converted. A pattern function gives no offsets, so a lookahead
    in front of the pattern captures the context.
    """
    context_first = "(?s)(?=(.{0,30}))(?-s)" + _AMOUNT
    whole = "(?s)(?=(.{0,30}))(?-s)(" + _AMOUNT + ")"
    groups = lambda pattern, k: F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(k))
    found = F.arrays_zip(
        groups(whole, 2).alias("raw"), groups(context_first, 1).alias("context"), groups(context_first, 2).alias("a"), groups(context_first, 3).alias("ak"), groups(context_first, 4).alias("b"), groups(context_first, 5).alias("bk")
    )
    number = lambda n, k: F.expr("double(null)") if n is None else F.try_to_number(F.regexp_replace(n, ",", ""), F.lit("999999999999")).cast("double") * F.when(k != "", F.lit(1000.0)).otherwise(F.lit(1.0))
    rows = F.transform(
        found,
        lambda m: F.struct(number(F.nullif(m["a"], F.lit("")), m["ak"]).alias("min"), number(F.nullif(m["b"], F.lit("")), m["bk"]).alias("max"), m["raw"].alias("raw"), F.concat(m["raw"], m["context"]).alias("context")),
    )
    annual = F.filter(rows, lambda m: m["context"].rlike("(?i)k|annual|year|yr") | (m["min"] >= 50))
    longest = F.array_max(F.transform(annual, lambda m, i: F.struct(F.length(m["raw"]).alias("n"), (-i).alias("i"), m.alias("m"))))
    best = longest["m"]
    return F.struct(best["min"].alias("min"), best["max"].alias("max"), best["raw"].alias("raw"))


#: What tells of rupees at all, and the pieces that their amounts are made of. Fixed values.
_INR_SIGNAL = r"(?i)₹|Rs\.?\s*\d|INR\s*\d|\d+(?:\.\d+)?\s*(?:LPA|lakh|crore)\b|\d+(?:\.\d+)?\s*L\b"
_INR_PIECES = {
    "currency": r"₹|Rs\.?\s*|INR\s*", "number": r"\d+(?:\.\d+)?", "grouped": r"\d+(?:,\d{2,3})*(?:\.\d+)?", "groups": r"\s*(?:,\d{2,3})*\s*", "unit": r"lakh|lpa|crore|cr\b|L\b", "dash": r"\s*(?:[-–—]|to)\s*", "space": r"\s*",
}
_RUPEES = {"lakh": 100_000, "lpa": 100_000, "l": 100_000, "crore": 10_000_000, "cr": 10_000_000}
_pieces = {k: re.compile(v, re.I) for k, v in _INR_PIECES.items()}
_inr_start = re.compile(r"₹|Rs|INR|\d", re.I)


class _Reader:
    """Reads the pieces of an amount from a place in a text on."""

    def __init__(self, text: str, at: int):
        self.text, self.start, self.at = text, at, at

    def take(self, *kinds: str) -> list[str] | None:
        """The pieces in this order, or None and nothing taken."""
        at, out = self.at, []
        for kind in kinds:
            m = _pieces[kind].match(self.text, at)
            if m is None:
                return None
            out.append(m[0])
            at = m.end()
        self.at = at
        return out

    def unit(self) -> int | None:
        got = self.take("space", "unit")
        return _RUPEES[got[1].lower()] if got else None

    def amount(self, kind: str) -> tuple[float, int | None] | None:
        """A number and the rupees of its unit. A plain number ends before its first comma, and groups behind it are passed over."""
        got = self.take(kind)
        if got is None:
            return None
        if kind == "number":
            self.take("groups")
        return float(got[0].replace(",", "")), self.unit()


def _range(r: _Reader) -> tuple[float, float | None] | None:
    """Two amounts with a dash between; lakhs unless a unit says otherwise, and the second takes the unit of the first."""
    r.take("currency", "space")
    low = r.amount("number")
    if low is None or r.take("dash") is None:
        return None
    r.take("currency")
    high = r.amount("number")
    if high is None:
        return None
    return low[0] * (low[1] or 100_000), high[0] * (high[1] or low[1] or 100_000)


def _marked(r: _Reader) -> tuple[float, float | None] | None:
    """An amount behind a currency sign, in rupees unless it has a unit."""
    got = r.take("currency", "space") and r.amount("grouped")
    return (got[0] * (got[1] or 1), None) if got else None


def _in_units(r: _Reader) -> tuple[float, float | None] | None:
    """A bare number with a unit."""
    got = r.take("number")
    unit = r.unit() if got else None
    return (float(got[0]) * unit, None) if unit else None


def _rupee_amounts(text: str) -> Iterator[tuple[float, float | None, str]]:
    """(low, high, text) of the amounts in a text, from left to right."""
    at = 0
    while m := _inr_start.search(text, at):
        at = m.start() + 1
        for form in (_range, _marked, _in_units):
            r = _Reader(text, m.start())
            if found := form(r):
                yield *found, text[r.start : r.at].strip()
                at = r.at
                break


def inr_salary(text: str) -> tuple[float | None, float | None, str | None]:
    """(min, max, raw) in dollars of the longest rupee amount between 50 thousand and 500 million rupees, the first of equals."""
    sound = [x for x in _rupee_amounts(text) if 50_000 <= x[0] <= 500_000_000]
    if not sound:
        return None, None, None
    low, high, raw = max(sound, key=lambda x: len(x[2]))
    return *(None if x is None else float(math.floor(x * dims.INR_TO_USD + 0.5)) for x in (low, high)), raw


def _inr_frame(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if t is None else inr_salary(t) for t in texts], columns=["min", "max", "raw"])


def salary(text: Column) -> Column:
    """Rupee amounts first, where a rupee signal stands, else dollars, euros and pounds. Only texts with the signal
    reach Python."""
    rupees = F.pandas_udf(_inr_frame, SALARY_TYPE)(F.when(text.rlike(_INR_SIGNAL), text))
    return F.when(rupees["raw"].isNotNull(), rupees).otherwise(extract_salary(text))


def component_salary(components: Column, summary: Column) -> Column:
    """struct of the first dollar component with a minimum or a maximum, else null."""
    usd = F.get(F.filter(components, lambda c: (c["currencyCode"] == "USD") & (c["min"].isNotNull() | c["max"].isNotNull())), F.lit(0))
    return F.when(usd.isNotNull(), F.struct(usd["min"].alias("min"), usd["max"].alias("max"), F.coalesce(summary, usd["summary"]).alias("raw")))


def aggregator_salary(low: Column, high: Column, predicted: Column, country: Column) -> Column:
    """struct of an aggregator's salary: rupees converted for India, else as it is; null if predicted or missing."""
    half_up = lambda c: F.floor(c + 0.5).cast("double")
    lakhs = lambda c: F.concat(F.lit("₹"), half_up(c / 100_000).cast("bigint").cast("string"), F.lit("L"))
    thousands = lambda c: F.concat(F.lit("$"), half_up(c / 1000).cast("bigint").cast("string"), F.lit("k"))
    both = low.isNotNull() & high.isNotNull()
    india = F.struct(half_up(low * dims.INR_TO_USD).alias("min"), half_up(high * dims.INR_TO_USD).alias("max"), F.when(both, F.concat(lakhs(low), F.lit(" - "), lakhs(high))).when(low.isNotNull(), lakhs(low)).alias("raw"))
    other = F.struct(low.alias("min"), high.alias("max"), F.when(both, F.concat(thousands(low), F.lit(" - "), thousands(high))).alias("raw"))
    return F.when((low.isNotNull() | high.isNotNull()) & ~predicted.eqNullSafe(F.lit(1)), F.when(country == "in", india).otherwise(other))
