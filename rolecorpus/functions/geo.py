"""Place columns: normal forms, cities, countries and matches between a query's and a posting's place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .text import WS, content_part, let


def normalize_location(location: Column) -> Column:
    key = F.trim(F.regexp_replace(F.trim(F.lower(location)), WS, " "))
    table = F.create_map(*[F.lit(x) for pair in dims.LOCATION_NORM.items() for x in pair])
    return F.when(location != "", F.coalesce(F.try_element_at(table, key), location))


def extract_location(text: Column) -> Column:
    """What follows the first label such as 'Based in:'; null if there is none."""
    pattern = "(?iu)(?:Location|Based in|Office|Working from)\\s*[:\\-–—]\\s*(\\p{L}[\\p{L}\\p{N} ,/&-]{1,60})"
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def _padded(place: Column) -> Column:
    return F.concat(F.lit(" "), content_part(place), F.lit(" "))


def _city_tests(padded: Column) -> list[tuple[str, str, Column]]:
    out = []
    for city, country, synonyms in dims.CITIES:
        test = F.lit(False)
        for s in synonyms:
            if "," not in s:  # a synonym with a comma never occurs in normalised text
                test = test | padded.contains(f" {dims.normalized(s)} ")
        out.append((city, country, test))
    return out


def tag_cities(place: Column) -> Column:
    """Names of all cities of which a synonym occurs on word boundaries, in the order of the dimension."""
    return let(_padded(place), lambda t: F.array_compact(F.array(*[F.when(test, F.lit(city)) for city, _, test in _city_tests(t)])))


def country_code(place: Column) -> Column:
    """The country that the place names, else that of its first city, else null."""
    alias = F.create_map(*[F.lit(x) for pair in dims.COUNTRY_ALIASES.items() for x in pair])
    first = let(_padded(place), lambda t: F.coalesce(*[F.when(test, F.lit(country)) for _, country, test in _city_tests(t)]))
    return F.when(F.trim(place) != "", F.coalesce(F.try_element_at(alias, content_part(place)), first))


def country_flag(place: Column, country: str = "IN", word: str = "india") -> Column:
    """Whether the place names the country, one of its aliases, or one of its cities."""
    aliases = [a for a, c in dims.COUNTRY_ALIASES.items() if c == country]

    def named(t: Column) -> Column:
        out = t.contains(f" {word} ") | F.trim(t).isin(aliases)
        for _, c, test in _city_tests(t):
            if c == country:
                out = out | test
        return out

    return F.coalesce(let(_padded(place), named), F.lit(False))


def location_terms(queries: DataFrame, location_col: str = "location") -> DataFrame:
    """``queries`` with loc_terms: the synonyms of every city that the location names, or else the raw location,
    as text that a normalised place may contain. A location in several parts keeps its commas and matches nothing."""
    synonyms = F.create_map(*[F.lit(x) for c, _, s in dims.CITIES for x in (c, ",".join(dims.normalized(t) for t in s if "," not in t))])
    cities = F.flatten(F.transform(tag_cities(F.col(location_col)), lambda c: F.split(F.element_at(synonyms, c), ",")))
    return queries.withColumn("loc_terms", F.when(F.trim(location_col) != "", F.when(F.size(cities) > 0, F.array_distinct(cities)).otherwise(F.array(F.lower(F.trim(location_col))))))


def location_matches(place: Column, loc_terms: Column) -> Column:
    """No wanted place: true. No known place: false. Else whether one of the terms occurs on word boundaries."""
    padded = F.concat(F.lit(" "), content_part(place), F.lit(" "))
    hit = F.exists(loc_terms, lambda t: padded.contains(F.concat(F.lit(" "), t, F.lit(" "))))
    return F.when(loc_terms.isNull(), F.lit(True)).when(F.coalesce(F.trim(place), F.lit("")) == "", F.lit(False)).otherwise(hit)


def multi_part_location(parts: Column) -> Column:
    """Parts of an address, the empty ones left out, joined by commas; null if none is left."""
    return F.nullif(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), ", "), F.lit(""))
