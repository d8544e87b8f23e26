"""Address columns: canonical form, class, company and tenant of a posting's URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import let


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    """The path; '/' if there is none; null if the URL is malformed."""
    h = F.try_parse_url(url, F.lit("HOST"))
    return F.when(h.isNotNull(), F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")))


def strip_locale(p: Column) -> Column:
    return F.regexp_replace(p, "^/[a-z]{2}(-[a-zA-Z]{2})?/", "/")


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def canonical_url(url: Column) -> Column:
    """Without query, fragment, locale prefix and one trailing slash, in lower case; a malformed URL is cut at ? or #."""
    whole = F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")), strip_locale(path(url)))
    return F.lower(F.regexp_replace(F.coalesce(whole, F.regexp_extract(url, "^[^?#]*", 0)), "/$", ""))


def _host_is(h: Column, tests: list[str]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | (h.endswith(t) if t.startswith(".") else h == t)
    return out


def classify_url(url: Column) -> Column:
    """marketing, individual_job, company_careers_listing or unknown; earlier rules win."""
    parts = F.struct(host(url).alias("h"), strip_locale(path(url)).alias("p"))
    return let(parts, lambda x: _class_of(x["h"], x["p"]))


def _class_of(h: Column, p: Column) -> Column:
    low = F.lower(p)
    denied = F.lit(False)
    for fragment in dims.DENY_PATHS:
        denied = denied | low.contains(fragment)
    vendor = F.lit(False)
    for vendor_host, prefix in dims.VENDOR_CAREERS:
        vendor = vendor | ((h == vendor_host) & p.startswith(prefix))
    out = F.when(h.isNull(), "unknown").when(denied | vendor, "marketing")
    for _, tests, pattern in dims.JOB_URL_RULES:
        out = out.when(_host_is(h, tests), F.when(p.rlike(pattern), "individual_job").otherwise("company_careers_listing"))
    return out.otherwise("unknown")


def title_denied(title: Column) -> Column:
    vendor = title.rlike(dims.VENDOR_SUFFIX) & ~title.rlike(dims.ROLE_TOKENS)
    return F.coalesce(vendor | title.rlike(dims.AUTHOR_TITLE) | title.rlike(dims.EXPIRED_TITLE), F.lit(False))


def has_jobposting_schema(text: Column) -> Column:
    out = F.lit(False)
    for hint in dims.SCHEMA_HINTS:
        out = out | text.rlike(hint)
    return F.coalesce(out, F.lit(False))


def company_from_url(url: Column) -> Column:
    """The company that a board's URL names by segment, subdomain or query, else null."""
    parts = F.struct(host(url).alias("h"), F.get(segments(path(url)), F.lit(0)).alias("first"), F.try_parse_url(url, F.lit("QUERY"), F.lit("for")).alias("board"))
    return let(parts, lambda x: _company_of(x["h"], x["first"], x["board"]))


def _company_of(h: Column, first: Column, board: Column) -> Column:
    sub = lambda domain: F.nullif(F.regexp_extract(h, rf"^([^.]+)\.{domain}$", 1), F.lit(""))
    return (
        F.when(h.endswith("greenhouse.io") & first.isNotNull(), F.when(F.lower(first) == "embed", board).otherwise(first))
        .when(h.isin("jobs.lever.co", "jobs.ashbyhq.com", "apply.workable.com") & first.isNotNull(), first)
        .when(h.endswith("myworkdayjobs.com"), sub(r"myworkdayjobs\.com"))
        .when(h.endswith("smartrecruiters.com"), F.when(first.isNotNull() & (F.lower(first) != "careers"), first).otherwise(sub(r"smartrecruiters\.com")))
        .when(h.endswith("bamboohr.com"), F.coalesce(sub(r"bamboohr\.com"), first))
        .when(h.endswith("recruitee.com"), sub(r"recruitee\.com"))
        .when(h.endswith("personio.de"), F.coalesce(sub(r"personio\.de"), first))
        .when(h.endswith("teamtailor.com"), F.nullif(F.regexp_extract(h, r"^(?:[^.]+\.)?([^.]+)\.teamtailor\.com$", 1), F.lit("")))
    )


def tenant_from_url(url: Column) -> Column:
    """struct(ats, slug) of a board or board-API URL, else null; the slug is decoded, lower-cased, without a leading @."""
    return let(F.struct(host(url).alias("h"), segments(path(url)).alias("p")), lambda x: _tenant_of(x["h"], x["p"]))


def _tenant_of(h: Column, parts: Column) -> Column:
    p = [F.get(parts, F.lit(k)) for k in range(3)]
    slug = lambda s: F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(F.try_url_decode(s), s)), "^@", ""), "/+$", ""))
    pair = lambda ats, s: F.struct(F.lit(ats).alias("ats"), slug(s).alias("slug"))
    api = lambda name, a, b: (h == name) & (p[0] == a) & (p[1] == b) & p[2].isNotNull()
    return (
        F.when(h.isin("boards.greenhouse.io", "job-boards.greenhouse.io") & p[0].isNotNull(), pair("greenhouse", p[0]))
        .when(api("boards-api.greenhouse.io", "v1", "boards"), pair("greenhouse", p[2]))
        .when((h == "jobs.lever.co") & p[0].isNotNull(), pair("lever", p[0]))
        .when(api("api.lever.co", "v0", "postings"), pair("lever", p[2]))
        .when((h == "jobs.ashbyhq.com") & p[0].isNotNull(), pair("ashby", p[0]))
        .when(api("api.ashbyhq.com", "posting-api", "job-board"), pair("ashby", p[2]))
        .when((h == "jobs.smartrecruiters.com") & p[0].isNotNull(), pair("smartrecruiters", p[0]))
        .when(api("api.smartrecruiters.com", "v1", "companies"), pair("smartrecruiters", p[2]))
    )
