"""Crawl frontier: links of pages, robots rules, and two-pass extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .feeds import read_jsonld

#: Addresses of single postings by their path.
JOB_HREF = r"(?i)href=[\"']([^\"'#?]*(?:/jobs?/|/positions?/|/openings?/|/careers?/(?!search|listing|all))[^\"'#?]{3,})[^\"']*[\"']"


def resolve(href: Column, base: Column) -> Column:
    """An address on the origin of ``base``: absolute ones as they are, relative ones from the root; null if another scheme."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return (
        F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href)).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(origin, F.lit("/"), href))
    )


def discover_links(pages: DataFrame, pattern: str = JOB_HREF, most: int = 20) -> DataFrame:
    """(page_url, link, pos): the first ``most`` distinct links of each page (url, html) to its own host that match.
    A page's links are counted inside its row, without a shuffle."""
    hrefs = F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), lambda h: resolve(F.trim(h), F.col("url")))
    own = F.filter(hrefs, lambda h: h.isNotNull() & (urls.host(h) == urls.host(F.col("url"))))
    return pages.select(F.col("url").alias("page_url"), F.posexplode(F.slice(F.array_distinct(own), 1, most)).alias("pos", "link"))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, prefix) that robots texts (origin, body) disallow for every agent or for ours. A user-agent line holds
    until the next."""
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line")).filter(~F.col("line").startswith("#"))
    name = F.when(F.lower("line").startswith("user-agent:"), F.trim(F.substring("line", 12, 1000)))
    last = F.last(name, ignorenulls=True).over(Window.partitionBy("origin").orderBy("n"))
    applies = (F.col("agent") == "*") | F.contains(F.lower("agent"), F.lit(agent.lower()))
    rules = lines.withColumn("agent", last).filter(F.lower("line").startswith("disallow:") & applies)
    return rules.select("origin", F.trim(F.substring("line", 10, 10_000)).alias("prefix")).filter("prefix != ''").distinct()


def robots_filter(frontier: DataFrame, rules: DataFrame, honour_root: bool = False) -> DataFrame:
    """The addresses (url) that no rule of their origin forbids. A rule for the whole site counts only if ``honour_root``.

    An address meets a rule by equality: of its path the beginnings of those lengths that its site's rules have join the rules by
    (origin, prefix), so a site with many rules costs an address one look-up for each length and never a walk through them.
    """
    used = (rules if honour_root else rules.filter("prefix != '/'")).select("origin", "prefix").distinct()
    lengths = used.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    paths = frontier.select("url").distinct().select("url", F.lower(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)).alias("origin"), urls.path(F.col("url")).alias("path"))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    begun = paths.join(lengths, "origin").select("url", "origin", F.explode(F.transform(fitting, lambda n: F.substr("path", F.lit(1), n))).alias("prefix"))
    blocked = begun.join(used, ["origin", "prefix"], "left_semi").select("url").distinct()
    return frontier.join(blocked, "url", "left_anti").select(*frontier.columns)


def two_pass_extract(seeds: DataFrame, pages: DataFrame, pattern: str = JOB_HREF) -> DataFrame:
    """Postings of the seed pages (url, html, company); for seeds without any, those of the linked pages (url, html)."""
    direct = read_jsonld(seeds)
    empty = seeds.join(direct.select(F.col("page_url").alias("url")).distinct(), "url", "left_anti")
    links = discover_links(empty, pattern).join(empty.select(F.col("url").alias("page_url"), "company"), "page_url")
    linked = links.groupBy(F.col("link").alias("url")).agg(F.min("company").alias("company")).join(pages.select("url", "html"), "url")
    return direct.unionByName(read_jsonld(linked))
