"""Posting feeds: landed payloads to the common posting columns.

Each reader takes a table of payloads (slug, body), one row per landed file, and parses the body with an explicit
schema; a body of another shape gives no rows. ``land`` reads a folder of files into that table. Where a board comes in pages, a
column ``page`` gives their order; without it each payload is a board of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import freshness, geo, salary, text, urls


def land(spark: SparkSession, path: str) -> DataFrame:
    """(slug, body) of the files in a folder, the slug being a file's name without its extension."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("slug"), F.col("value").alias("body"))


def _blank(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def _posting(df: DataFrame, source: str, *, url: Column, title: Column, company: Column, place: Column, description: Column, published: Column, flag: Column | None = None, final: bool = True, structured: Column | None = None, keep: list[str] = ()) -> DataFrame:
    cols = df.select(
        *keep, url.alias("url"), title.alias("title"), company.alias("company"), place.alias("location_raw"), geo.normalize_location(place).alias("location"), description.alias("description"), published.alias("published_at"),
        text.remote_flag(place, description, flag, final).alias("is_remote"), (structured if structured is not None else F.lit(None).cast(salary.SALARY_TYPE)).alias("structured"),
    )
    paid = cols.withColumn("paid", F.coalesce("structured", salary.salary(F.when(F.col("structured").isNull(), F.col("description")))))
    out = paid.withColumns({
        "source": F.lit(source), "salary_min_usd": F.col("paid.min"), "salary_max_usd": F.col("paid.max"), "salary_raw": F.col("paid.raw"), "dedup_key": text.dedup_key(F.col("title"), F.col("company"), F.col("location")),
    })
    return out.select(*keep, *schemas.POSTING_COLUMNS)


def page_starts(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """``sizes`` (keys, page, n), one narrow row for each page, with ``start``: how many postings the pages before hold. Pages that share a
    number and a size are one page that was landed twice."""
    before = Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.groupBy(*keys, "page").agg(F.max("n").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def read_greenhouse(payloads: DataFrame) -> DataFrame:
    """The company is that of the board's first posting, on whatever page it stands, or else the slug."""
    parsed = payloads.withColumn("b", F.from_json("body", schemas.GREENHOUSE))
    said = _blank(F.get("b.jobs", F.lit(0))["company_name"])
    if "page" in payloads.columns:
        first = parsed.filter(F.size("b.jobs") > 0).groupBy("slug").agg(F.min_by(F.struct(said.alias("said")), "page").alias("first"))
        boards = parsed.select("slug", "b").join(first, "slug").withColumn("board", F.coalesce("first.said", "slug"))
    else:
        boards = parsed.withColumn("board", F.coalesce(said, "slug"))
    rows = boards.select("board", F.explode("b.jobs").alias("j"))
    return _posting(rows, "greenhouse", url=F.col("j.absolute_url"), title=F.col("j.title"), company=F.col("board"), place=_blank(F.col("j.location.name")), description=F.coalesce(text.html_to_text(F.col("j.content")), F.lit("")), published=freshness.published_at(iso=F.col("j.first_published")))


def read_lever(payloads: DataFrame) -> DataFrame:
    """Bodies that are no array failed; the company is the slug's words."""
    rows = payloads.filter(F.ltrim("body").startswith("[")).select("slug", F.explode(F.from_json("body", schemas.LEVER)).alias("j"))
    about = text.assemble_description(F.col("j.descriptionPlain"), F.col("j.description"), F.col("j.additional"))
    return _posting(rows, "lever", url=F.col("j.hostedUrl"), title=F.col("j.text"), company=text.slug_to_name(F.col("slug")), place=_blank(F.col("j.categories.location")), description=about, published=freshness.published_at(epoch_ms=F.col("j.createdAt")))


def read_ashby(payloads: DataFrame) -> DataFrame:
    """The plain description before the html, the apply address before the posting's, a dollar component before the text."""
    rows = payloads.withColumn("b", F.from_json("body", schemas.ASHBY)).withColumn("board", F.coalesce(_blank(F.col("b.jobBoard.name")), "slug")).select("board", F.explode("b.jobs").alias("j"))
    about = F.coalesce(_blank(F.col("j.descriptionPlain")), text.html_to_text(F.col("j.descriptionHtml")), F.lit(""))
    return _posting(
        rows, "ashby", url=F.coalesce(F.nullif("j.applyUrl", F.lit("")), "j.jobUrl"), title=F.col("j.title"), company=F.col("board"), place=_blank(F.col("j.location")), description=about, published=freshness.published_at(iso=F.col("j.publishedAt")),
        flag=F.col("j.isRemote"), structured=salary.component_salary(F.col("j.compensation.summaryComponents"), F.col("j.compensation.compensationTierSummary")),
    )


def read_smartrecruiters(lists: DataFrame, details: DataFrame, most: int | None = None) -> DataFrame:
    """The postings of each slug with their details (ref, body), all or the first ``most``; a posting without a detail is an error
    and gives no row.

    A posting's place in its slug is its place on its page after the postings of the pages before, counted in one row for each
    page: postings are not sorted, and the cap is the slug's however it was cut into pages."""
    pages = lists.select("slug", F.col("page") if "page" in lists.columns else F.lit(0).alias("page"), F.from_json("body", schemas.SMARTRECRUITERS_LIST)["content"].alias("content"))
    if most is None:
        rows = pages.select("slug", F.explode("content").alias("p"))
    else:
        starts = page_starts(pages.select("slug", "page", F.coalesce(F.size("content"), F.lit(0)).alias("n")), ["slug"]).filter(F.col("start") < most).select("slug", "page", "start")
        rows = pages.join(starts, ["slug", "page"]).select("slug", "start", F.posexplode("content").alias("n", "p")).filter(F.col("start") + F.col("n") < most)
    detail = details.select("ref", F.from_json("body", schemas.SMARTRECRUITERS_DETAIL).alias("d")).dropDuplicates(["ref"])
    both = rows.join(detail, F.col("p.ref") == detail.ref)
    parts = [F.col(f"d.jobAd.sections.{s}.text") for s in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")]
    about = text.collapse(F.concat_ws(" ", *[F.nullif(text.html_to_text(p), F.lit("")) for p in parts]))
    place = F.coalesce("d.location", "p.location")
    return _posting(
        both, "smartrecruiters", url=F.coalesce(F.nullif("d.applyUrl", F.lit("")), F.nullif("d.postingUrl", F.lit("")), "p.ref"), title=F.col("p.name"), company=F.coalesce(_blank(F.col("d.company.name")), _blank(F.col("p.company.name")), "slug"),
        place=_blank(place["fullLocation"]), description=about, published=freshness.published_at(iso=F.coalesce("d.releasedDate", "p.releasedDate")), flag=place["remote"], final=False,
    )


def read_workday(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Listed postings (slug, company, base_url, body) with their details (externalPath, body) where there are any;
    they have no date."""
    rows = lists.select("company", "base_url", F.explode(F.from_json("body", schemas.WORKDAY_LIST)["jobPostings"]).alias("p"))
    detail = details.select(F.col("externalPath").alias("path"), F.from_json("body", schemas.WORKDAY_DETAIL).alias("d")).dropDuplicates(["path"])
    both = rows.join(detail, F.col("p.externalPath") == detail.path, "left")
    return _posting(
        both, "workday", url=F.coalesce(_blank(F.col("d.externalUrl")), F.concat("base_url", "p.externalPath")), title=F.trim(F.coalesce("d.title", "p.title")), company=F.col("company"),
        place=_blank(F.coalesce("d.location", "p.locationsText")), description=F.coalesce(text.html_to_text(F.col("d.jobDescription")), F.lit("")), published=F.lit(None).cast("timestamp"),
    )


def read_adzuna(payloads: DataFrame) -> DataFrame:
    """Postings without a title are skipped; predicted salaries are ignored. The slug is the country."""
    rows = payloads.select("slug", F.explode(F.from_json("body", schemas.ADZUNA)["results"]).alias("j")).filter(F.trim("j.title") != "")
    place = F.coalesce(_blank(F.col("j.location.display_name")), geo.multi_part_location(F.col("j.location.area")))
    return _posting(
        rows, "adzuna", url=F.col("j.redirect_url"), title=F.trim("j.title"), company=F.coalesce(_blank(F.col("j.company.display_name")), F.lit("Unknown")), place=place, description=F.coalesce(F.trim("j.description"), F.lit("")),
        published=freshness.published_at(iso=F.col("j.created")), structured=salary.aggregator_salary(F.col("j.salary_min"), F.col("j.salary_max"), F.col("j.salary_is_predicted"), F.col("slug")),
    )


def jsonld_blocks(pages: DataFrame) -> DataFrame:
    """(url, item): the JSON-LD objects of pages whose type is exactly JobPosting; broken blocks are skipped."""
    pattern = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    hinted = pages.filter(urls.has_jobposting_schema(F.col("html")))
    blocks = hinted.select("url", F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("block")).withColumn("v", F.try_parse_json(F.trim("block"))).filter("v is not null")
    one = F.array(F.col("v"))
    items = blocks.select("url", F.explode(F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(one)).alias("item"))
    return items.filter(F.try_variant_get("item", "$['@type']", "string") == "JobPosting")


def read_jsonld(pages: DataFrame) -> DataFrame:
    """Postings that pages (url, html, company) declare as structured data; page_url is kept."""
    got = lambda p, kind="string": F.try_variant_get("j", p, kind)
    companies = pages.select("url", "company").dropDuplicates(["url"])
    rows = jsonld_blocks(pages).join(companies, "url").select(F.col("url").alias("page_url"), F.col("company").alias("fallback"), F.col("item").alias("j"))
    kind = lambda p: F.schema_of_variant(F.try_variant_get("j", p, "variant"))
    spot = lambda leaf: F.when(kind("$.jobLocation").startswith("ARRAY"), got(f"$.jobLocation[0].address{leaf}")).otherwise(got(f"$.jobLocation.address{leaf}"))
    parts = geo.multi_part_location(F.array(spot(".addressLocality"), spot(".addressRegion"), spot(".addressCountry")))
    address_kind = F.coalesce(F.when(kind("$.jobLocation").startswith("ARRAY"), kind("$.jobLocation[0].address")), kind("$.jobLocation.address"))
    place = F.when(address_kind == "STRING", _blank(spot(""))).otherwise(parts)
    low, high, one = got("$.baseSalary.value.minValue", "double"), got("$.baseSalary.value.maxValue", "double"), got("$.baseSalary.value.value", "double")
    usd = (got("$.baseSalary.currency") == "USD") & F.coalesce(low, high, one).isNotNull()
    whole = lambda c: F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    paid = F.when(usd, F.struct(F.coalesce(low, one).alias("min"), high.alias("max"), F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("$"), whole(low), F.lit(" - $"), whole(high))).alias("raw")))
    return _posting(
        rows, "jsonld", url=F.coalesce(_blank(got("$.url")), "page_url"), title=F.trim(F.coalesce(got("$.title"), F.lit(""))), company=F.coalesce(_blank(got("$.hiringOrganization.name")), "fallback"), place=place,
        description=text.html_to_text(F.coalesce(got("$.description"), F.lit(""))), published=freshness.published_at(iso=got("$.datePosted")), flag=F.when(got("$.jobLocationType") == "TELECOMMUTE", F.lit(True)), structured=paid, keep=["page_url"],
    )


def tenant_worklist(base: DataFrame, tenants: DataFrame, denied: DataFrame) -> DataFrame:
    """(ats, slug, position): base slugs (ats, slug, pos), then verified tenants, those with flagged jobs and most jobs
    first and unknown counts foremost, each slug once at its first place, without the denied."""
    found = tenants.filter("status = 'verified'").withColumn("pos", F.row_number().over(Window.partitionBy("ats").orderBy(F.desc_nulls_first("flagged"), F.desc_nulls_first("jobs_last_seen"), "slug")))
    every = base.select("ats", "slug", F.lit(0).alias("origin"), "pos").unionByName(found.select("ats", "slug", F.lit(1).alias("origin"), "pos"))
    first = every.groupBy("ats", "slug").agg(F.min(F.struct("origin", "pos")).alias("at"))
    left = first.withColumn("low", F.lower("slug")).join(denied.select("ats", F.col("slug").alias("low")), ["ats", "low"], "left_anti")
    return left.select("ats", "slug", F.row_number().over(Window.partitionBy("ats").orderBy("at", "slug")).alias("position"))


def snapshot_candidates(candidates: DataFrame, path: str, query_col: str = "raw_query") -> None:
    """Freezes candidate lists, one folder per query key."""
    candidates.withColumn("query_key", text.snapshot_key(F.col(query_col))).write.mode("overwrite").partitionBy("query_key").parquet(path)


def read_snapshot(spark: SparkSession, path: str, queries: DataFrame, query_col: str = "raw_query") -> DataFrame:
    """The frozen candidates of the queries; fails if a query has none."""
    frozen = spark.read.parquet(path)
    wanted = queries.select(text.snapshot_key(F.col(query_col)).alias("query_key")).distinct()
    missing = wanted.join(frozen.select("query_key").distinct(), "query_key", "left_anti").limit(1).count()
    if missing:
        raise LookupError("a query has no snapshot")
    return frozen.join(wanted, "query_key", "left_semi")


