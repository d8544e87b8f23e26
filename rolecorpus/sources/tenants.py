"""Tenants of posting boards: found in addresses and texts, verified, kept in a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geo, urls
from ..operators.merge import TENANT_POLICY, merge


def tenants_from_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """(ats, slug): distinct tenants that the addresses name."""
    return df.select(urls.tenant_from_url(F.col(url_col)).alias("t")).filter("t is not null").select("t.ats", "t.slug").distinct()


def tenants_from_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ats, slug): distinct tenants named by the addresses in each text."""
    found = df.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(r"(?i)https?://[^\s\"'<>),]+"), F.lit(0))).alias("url"))
    return found.select(id_col, urls.tenant_from_url(F.col("url")).alias("t")).filter("t is not null").select(id_col, "t.ats", "t.slug").distinct()


def union_candidates(sources: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Candidates (ats, slug, source), the first source of each winning, and how many each source has by itself."""
    every = None
    for rank, (name, df) in enumerate(sources):
        part = df.select("ats", "slug", F.lit(name).alias("source"), F.lit(rank).alias("rank"))
        every = part if every is None else every.unionByName(part)
    unique = every.dropDuplicates(["source", "ats", "slug"])
    first = unique.groupBy("ats", "slug").agg(F.min_by("source", "rank").alias("source"))
    return first, unique.groupBy("source").agg(F.count("*").alias("n"))


def new_candidates(candidates: DataFrame, registry: DataFrame, limit: int | None = None) -> DataFrame:
    fresh = candidates.join(registry.select("ats", "slug"), ["ats", "slug"], "left_anti")
    return fresh if limit is None else fresh.orderBy("ats", "slug").limit(limit)


def drop_denylisted(tenants: DataFrame, denied: DataFrame) -> DataFrame:
    keyed = tenants.withColumn("deny_slug", F.lower("slug"))
    return keyed.join(denied.select("ats", F.col("slug").alias("deny_slug")), ["ats", "deny_slug"], "left_anti").drop("deny_slug")


#: How many postings give sample titles, and how many are searched for one in the country.
SAMPLE, SEARCHED = 5, 50


def verify_tenants(payloads: DataFrame, denied: DataFrame) -> DataFrame:
    """(ats, slug, status, job_count, sample_titles, flagged, company_name), one row for each tenant, from answers (ats, slug, code, body) or,
    where a board answers in pages, (ats, slug, page, code, body).

    A page with code 404 is dead, with 429 rate-limited, with another failure or an unreadable body a candidate, else verified. A
    denied tenant is dead; else it is verified if one of its pages is, rate-limited if one is (it is to be asked again), a candidate
    if one is, and dead if all are. Of the verified pages, in their order: the number of jobs, the first five titles, whether one of
    the first fifty jobs is in the country, and the company that the first page with one names. Pages are counted in rows
    without their bodies; only the first fifty with jobs, which hold the first fifty jobs, meet in one row.
    """
    job = lambda t, p: F.struct(F.coalesce(t, F.lit("Untitled")).alias("title"), p.alias("place"))
    board = {
        "greenhouse": (schemas.GREENHOUSE, lambda b: F.transform(b["jobs"], lambda j: job(j["title"], j["location"]["name"]))),
        "lever": (schemas.LEVER, lambda b: F.transform(b, lambda j: job(j["text"], j["categories"]["location"]))),
        "ashby": (schemas.ASHBY, lambda b: F.transform(b["jobs"], lambda j: job(j["title"], j["location"]))),
        "smartrecruiters": (schemas.SMARTRECRUITERS_LIST, lambda b: F.transform(b["content"], lambda j: job(j["name"], F.coalesce(j["location"]["fullLocation"], geo.multi_part_location(F.array(j["location"]["city"], j["location"]["country"])))))),
    }
    jobs = F.coalesce(*[F.when(F.col("ats") == ats, read(F.from_json("body", schema))) for ats, (schema, read) in board.items()])
    company = F.when(F.col("ats") == "greenhouse", F.get(F.filter(F.from_json("body", schemas.GREENHOUSE)["jobs"]["company_name"], lambda c: c.isNotNull() & (c != "")), F.lit(0))).when(F.col("ats") == "ashby", F.from_json("body", schemas.ASHBY)["jobBoard"]["name"])
    status = F.when(F.col("code") == 404, "dead").when(F.col("code") == 429, "rate_limited").when(F.col("code").between(200, 299) & F.try_parse_json("body").isNotNull(), "verified").otherwise("candidate")
    read_ = payloads.withColumns({"page": F.col("page") if "page" in payloads.columns else F.lit(0), "status": status}).withColumn("jobs", F.when(F.col("status") == "verified", F.coalesce(jobs, F.array())))
    flagged_at = F.array_position(F.transform(F.slice("jobs", 1, SEARCHED), lambda j: F.coalesce(geo.country_flag(j["place"]), F.lit(False))), F.lit(True))
    pages = read_.select(
        "ats", "slug", "page", "status", F.coalesce(F.size("jobs"), F.lit(0)).alias("n"), F.slice("jobs.title", 1, SAMPLE).alias("titles"),
        flagged_at.alias("flagged_at"), F.when(F.col("status") == "verified", company).alias("company"),
    )
    is_ = lambda s: F.max(F.col("status") == s)
    whole = pages.groupBy("ats", "slug").agg(
        F.when(is_("verified"), "verified").when(is_("rate_limited"), "rate_limited").when(is_("candidate"), "candidate").otherwise("dead").alias("found"), F.sum("n").alias("job_count"),
        F.min_by("company", F.when(F.col("company").isNotNull(), F.col("page"))).alias("company_name"),
    )
    order = Window.partitionBy("ats", "slug").orderBy("page", "titles")
    first = pages.filter("n > 0").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= SEARCHED).groupBy("ats", "slug").agg(F.array_sort(F.collect_list(F.struct("at", "n", "titles", "flagged_at"))).alias("first"))
    before = F.aggregate("first", F.struct(F.lit(0).alias("seen"), F.lit(False).alias("hit")), lambda so, p: F.struct((so["seen"] + p["n"]).alias("seen"), (so["hit"] | ((p["flagged_at"] > 0) & (so["seen"] + p["flagged_at"] <= SEARCHED))).alias("hit")), lambda so: so["hit"])
    seen = whole.join(first, ["ats", "slug"], "left").withColumn("low", F.lower("slug")).join(denied.select("ats", F.col("slug").alias("low"), F.lit(True).alias("denied")), ["ats", "low"], "left")
    alive = F.col("denied").isNull()
    return seen.select(
        "ats", "slug", F.when(alive, F.col("found")).otherwise("dead").alias("status"), F.when(alive, F.col("job_count")).otherwise(0).cast("int").alias("job_count"),
        F.when(alive & F.col("first").isNotNull(), F.slice(F.flatten("first.titles"), 1, SAMPLE)).otherwise(F.array()).alias("sample_titles"), (alive & F.coalesce(before, F.lit(False))).alias("flagged"), F.when(alive, F.col("company_name")).alias("company_name"),
    )


def upsert_tenants(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """The registry with a batch merged by (ats, slug): the source and time of discovery stay, a company name and a time of
    verification survive a batch without them, notes are replaced even by nothing."""
    return merge(registry, batch, ["ats", "slug"], TENANT_POLICY)


def discovery_summary(tenants: DataFrame) -> DataFrame:
    return tenants.groupBy("ats", "status").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"))


def top_flagged(tenants: DataFrame, n: int = 10) -> DataFrame:
    return tenants.filter("flagged").orderBy(F.desc_nulls_last("jobs_last_seen"), "ats", "slug").limit(n)


def probe_counts(probes: DataFrame) -> DataFrame:
    """Hits and totals of probes (ats, slug, hit) by slug."""
    return probes.groupBy("slug").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"))


def verify_queue(tenants: DataFrame, n: int = 100) -> DataFrame:
    """The next tenants to verify: flagged ones first, then the longest known."""
    open_ = tenants.filter(F.col("status").isin("candidate", "rate_limited", "verified"))
    return open_.orderBy(F.desc_nulls_first("flagged"), F.asc_nulls_last("discovered_at"), "ats", "slug").limit(n)

