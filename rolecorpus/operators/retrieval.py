"""Batch retrieval: query keys and terms, the term index, division, ranking and filters.

A search is a table of queries joined to the corpus. Shuffles are by (query, posting) in the division and by query in
the ranking; the corpus's texts are read once, for the index.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions import geo, salary, urls
from ..functions.text import ascii_words, content_part, let
from ..scratch import broadcast_if_small, settle
from .merge import bucket_of

#: Weight of each field in the rank; a term's frequency counts as tf / (tf + 1).
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
FILTERS_TYPE = (
    "struct<role: string, seniority: string, skills: array<string>, location: string, remote: boolean, salaryMin: bigint, yearsExperience: bigint, exclude: array<string>, freshnessDays: bigint>"
)


# ---- understanding of queries ------------------------------------------------------------------------


def normalize_query(raw: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(raw)), r"[ \t\n\r\f\x0B]+", " ")


def query_keys(queries: DataFrame, raw_col: str, filters_col: str) -> DataFrame:
    """Adds raw_hash and full_hash. Filters count in the order of their names, arrays whatever their order,
    nulls and empty arrays not at all."""
    fields = queries.schema[filters_col].dataType
    parts = []
    for f in sorted(fields.fields, key=lambda f: f.name):
        c = F.col(f"{filters_col}.{f.name}")
        if isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, F.array_sort(c))
        parts.append(c.alias(f.name))
    q = normalize_query(F.col(raw_col))
    payload = F.to_json(F.struct(F.to_json(F.struct(*parts)).alias("f"), q.alias("q")))
    return queries.withColumns({"raw_hash": F.sha2(q, 256), "full_hash": F.sha2(payload, 256)})


def sanitize_filters(raw_json: Column) -> Column:
    """A filters struct from JSON text: fields of a wrong type are dropped, texts are trimmed and cut, numbers are
    whole and capped. A number written as a string is of the wrong type."""
    v = F.try_parse_json(raw_json)
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    is_text = lambda p: kind(p) == "STRING"
    is_number = lambda p: kind(p).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    text = lambda p, n: F.when(is_text(p), F.substring(F.trim(F.try_variant_get(v, p, "string")), 1, n))
    number = lambda p: F.when(is_number(p), F.try_variant_get(v, p, "double"))

    def texts(p: str) -> Column:
        items = F.when(kind(p).startswith("ARRAY"), F.try_variant_get(v, p, "array<variant>"))
        only = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
        return F.slice(F.transform(only, lambda x: F.try_variant_get(x, "$", "string")), 1, 20)

    years, fresh, least = number("$.yearsExperience"), number("$.freshnessDays"), number("$.salaryMin")
    return F.struct(
        F.nullif(text("$.role", 200), F.lit("")).alias("role"), text("$.seniority", 50).alias("seniority"), texts("$.skills").alias("skills"), text("$.location", 100).alias("location"),
        F.when(kind("$.remote") == "BOOLEAN", F.try_variant_get(v, "$.remote", "boolean")).alias("remote"),
        F.when(least > 0, F.floor(least)).alias("salaryMin"), F.when(years >= 0, F.least(F.floor(years), F.lit(80))).alias("yearsExperience"), texts("$.exclude").alias("exclude"),
        F.when(fresh > 0, F.least(F.floor(fresh), F.lit(365))).alias("freshnessDays"),
    )


def rule_parse(raw: Column, strict_aliases: bool = False) -> Column:
    """struct(role, location, remote, yearsExperience) by rule: years, cities joined by ' or ' (else the first country
    alias whose words all stand in the query), a remote flag, and the first four distinct words left. The whole query
    is the role if nothing is found. ``strict_aliases`` leaves out aliases of two letters, which words like 'in' are."""
    words = F.split(content_part(raw), " ")
    years = F.try_to_number(F.nullif(F.regexp_extract(raw, r"(?i)(\d{1,9})\+?\s*(?:years?|yrs?)", 1), F.lit("")), F.lit("999999999")).cast("int")
    cities = geo.tag_cities(raw)
    aliases = [a for a in dims.COUNTRY_ALIASES if not (strict_aliases and len(a) == 2)]
    alias = F.coalesce(*[F.when(F.forall(F.array(*[F.lit(w) for w in a.split()]), lambda w: F.array_contains(words, w)), F.lit(a)) for a in aliases])
    place = F.when(F.size(cities) > 0, F.array_join(cities, " or ")).otherwise(alias)
    remote = F.when(raw.rlike(ascii_words(r"(?i)\b(remote|remote-first|work from home|wfh)\b")), F.lit(True))
    skip = sorted({*dims.FILLER_WORDS, *(w for _, _, s in dims.CITIES for t in s for w in dims.normalized(t).split()), *(w for a in dims.COUNTRY_ALIASES for w in a.split())})
    left = F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~w.isin(skip))
    role = F.nullif(F.array_join(F.slice(F.array_distinct(left), 1, 4), " "), F.lit(""))
    nothing = role.isNull() & place.isNull() & remote.isNull() & years.isNull()
    return F.struct(F.when(nothing, raw).otherwise(role).alias("role"), place.alias("location"), remote.alias("remote"), F.when(years.isNotNull(), F.least(years, F.lit(80))).alias("yearsExperience"))


def parse_route(raw: Column) -> Column:
    """'rule' for years and a city, 'fast' for a short plain title, else 'model'."""
    q = F.trim(raw)
    has_city = F.size(geo.tag_cities(q)) > 0
    plain = (F.length(q) > 0) & (F.length(q) < 80) & ~has_city & ~q.rlike(ascii_words(dims.FILTER_TRIGGERS)) & (F.size(F.split(q, r"[ \t\n\r\f\x0B]+")) <= 5) & ~q.rlike(ascii_words(r"\b[A-Z][a-z]{2,}\b"))
    return F.when(q.rlike(ascii_words(r"(?i)\b\d+\+?\s*(?:years?|yrs?)\b")) & has_city, "rule").when(plain, "fast").otherwise("model")


def query_terms(queries: DataFrame, parts: list[str], id_col: str = "query_id") -> DataFrame:
    """(query_id, term): the distinct words of two letters or more in the parts, stop-words left out.
    A query without any gives no row."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in parts]))
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= 2) & ~w.isin(dims.STOP_WORDS)))
    return queries.select(id_col, F.explode(words).alias("term"))


# ---- the index and the search ------------------------------------------------------------------------


def stemmer(stem) -> callable:
    """A column function of arrays of words from a plain function of one word, run on Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run


def index_words(c: Column, stem=None) -> Column:
    """The words of a field that are indexed, one after another."""
    w = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: (F.length(x) >= 2) & ~x.isin(dims.STOP_WORDS))
    return stem(w) if stem else w


def counted(words: Column) -> Column:
    """Each distinct word of an array (term) with how often it stands there (tf): of the sorted words, the distance to where the next begins."""

    def runs(s: Column) -> Column:
        begins = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return let(begins, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return let(F.sort_array(words), runs)


def build_index(postings: DataFrame, stem=None) -> DataFrame:
    """(term, id, field, tf) over title (A), company (B) and description (C). A posting's words are sorted and counted in its
    own row, so nothing is shuffled; ``write_index`` lays the rows out by term."""

    fields = F.array(*[F.struct(F.lit(f).alias("field"), counted(index_words(F.col(c), stem)).alias("terms")) for f, c in (("A", "title"), ("B", "company"), ("C", "description"))])
    each = postings.select("id", F.explode(fields).alias("f")).select("id", "f.field", F.explode("f.terms").alias("t"))
    return each.select("t.term", "id", "field", "t.tf")


def wanted_words(postings: DataFrame, terms: DataFrame, stem=None) -> DataFrame:
    """(id, field, term), a row for each place where a posting holds one of the terms (term): other words go as they are read."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), index_words(F.col(c), stem).alias("words")) for f, c in (("A", "title"), ("B", "company"), ("C", "description"))])
    each = postings.select("id", F.explode(fields).alias("f")).select("id", "f.field", F.explode("f.words").alias("term"))
    return each.join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")


def write_index(index: DataFrame, path: str, buckets: int = 256) -> None:
    """The index as a table partitioned by a hash bucket of the term and sorted by term within."""
    placed = index.withColumn("term_bucket", bucket_of("term", buckets))
    placed.repartition("term_bucket").sortWithinPartitions("term_bucket", "term").write.mode("overwrite").partitionBy("term_bucket").parquet(path)


def read_index(spark: SparkSession, path: str, terms: DataFrame, buckets: int = 256) -> DataFrame:
    """The part of a written index that terms (term) can be in: only their buckets are read."""
    asked = [r[0] for r in terms.select(bucket_of("term", buckets)).distinct().collect()]  # one number a bucket at most
    return spark.read.parquet(path).filter(F.col("term_bucket").isin(asked)).drop("term_bucket")


def match_all_terms(terms: DataFrame, postings: DataFrame | None, index: DataFrame | None = None) -> DataFrame:
    """(query_id, id, field, term, tf) of the postings that hold every term of a query: relational division.

    With a written ``index`` the terms prune it; without one the postings' words are matched as they are read, and only wanted
    ones are counted and shuffled. The rows of wanted terms are written once. A query's rarest term alone says which postings can match; its other terms are
    looked up for those by term and posting, so a common word never brings its postings together.
    """
    terms = settle(terms.select("query_id", "term").distinct(), "retrieval-terms")
    if index is None:
        held = wanted_words(postings, terms).groupBy("term", "id", "field").agg(F.count("*").alias("tf"))
    else:
        held = index.join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")
    hits = settle(held, "retrieval-hits")
    frequency = hits.groupBy("term").agg(F.count("*").alias("n_rows"))
    rarest = settle(terms.join(frequency, "term", "left").groupBy("query_id").agg(F.count("*").alias("n_terms"), F.min_by("term", F.struct(F.coalesce("n_rows", F.lit(0)), "term")).alias("term")), "retrieval-rarest")
    possible = hits.select("term", "id").distinct().join(broadcast_if_small(rarest), "term").select("query_id", "id", "n_terms")
    found = possible.join(broadcast_if_small(terms), "query_id").join(hits, ["term", "id"])
    full = found.groupBy("query_id", "id", "n_terms").agg(F.collect_set("term").alias("held"), F.collect_list(F.struct("field", "term", "tf")).alias("hits")).filter(F.size("held") == F.col("n_terms"))
    return full.select("query_id", "id", F.explode("hits").alias("h")).select("query_id", "id", "h.field", "h.term", "h.tf")


def rank_topk(matches: DataFrame, postings: DataFrame, k: int = dims.TOP_K) -> DataFrame:
    """(query_id, id, rank, pos): weighted rank, newest first on ties with undated postings last, then by id."""
    weight = F.element_at(F.create_map(*[F.lit(x) for p in FIELD_WEIGHTS.items() for x in p]), F.col("field"))
    ranked = matches.groupBy("query_id", "id").agg(F.sum(weight * F.col("tf") / (F.col("tf") + 1)).alias("rank"))
    dated = ranked.join(postings.select("id", "published_at"), "id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rank", 9)), F.desc_nulls_last("published_at"), "id")
    return dated.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k).select("query_id", "id", "rank", "pos")


def widened(k: int) -> int:
    """How many results to rank when a filter on the place follows."""
    return max(40 * k, 2000)


def remote_postfilter(candidates: DataFrame) -> DataFrame:
    """If a query asks for remote work, postings that are known not to be remote go; unknown ones stay."""
    return candidates.filter(~(F.coalesce("remote", F.lit(False)) & F.col("is_remote").eqNullSafe(F.lit(False))))


def location_postfilter(candidates: DataFrame, k: int = dims.TOP_K) -> DataFrame:
    """Candidates (query_id, pos, location_raw, loc_terms) whose place matches, cut to ``k`` and numbered anew;
    raw_hits is how many the query had before."""
    counted = candidates.withColumn("raw_hits", F.count("*").over(Window.partitionBy("query_id")))
    kept = counted.filter(geo.location_matches(F.col("location_raw"), F.col("loc_terms")))
    return kept.withColumn("new_pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("new_pos") <= k).drop("pos").withColumnRenamed("new_pos", "pos")


def match_locations(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, place, n): the distinct places of postings (location_raw) that match each query (query_id, loc_terms), and how
    many postings have them. A query without a place gets one row, with no place and all postings.

    A term matches a place that holds it on word boundaries, that is, as a run of the place's words: the runs of distinct places and
    the distinct terms join by equality. Postings of a query follow by joining them on their place, below a limit.
    """
    places = postings.groupBy(F.coalesce("location_raw", F.lit("")).alias("place")).agg(F.count("*").alias("n"))
    wanted = queries.select("query_id", F.explode("loc_terms").alias("term"))
    longest = wanted.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    words = F.split(content_part(F.col("place")), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    held = places.filter(F.trim("place") != "").select("place", "n", F.explode(F.array_distinct(runs)).alias("term"))
    matched = held.join(wanted, "term").select("query_id", "place", "n").distinct()
    anywhere = queries.filter("loc_terms is null").select("query_id", F.lit(None).cast("string").alias("place"), F.lit(postings.count()).cast("long").alias("n"))
    return matched.unionByName(anywhere)


def backfill_salary(postings: DataFrame, text_col: str = "description") -> DataFrame:
    """Salary columns filled from the text where all three are empty."""
    empty = F.col("salary_min_usd").isNull() & F.col("salary_max_usd").isNull() & F.col("salary_raw").isNull()
    found = postings.withColumn("found_salary", F.when(empty, salary.salary(F.col(text_col))))
    return found.withColumns({
        "salary_min_usd": F.coalesce("salary_min_usd", "found_salary.min"), "salary_max_usd": F.coalesce("salary_max_usd", "found_salary.max"), "salary_raw": F.coalesce("salary_raw", "found_salary.raw"),
    }).drop("found_salary")


def needs_fallback(queries: DataFrame, candidates: DataFrame, below: int = dims.FALLBACK_BELOW) -> DataFrame:
    """(query_id, n, fallback) for every query, those without a candidate too."""
    n = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < below).alias("fallback"))


# ---- quality and order of candidates -----------------------------------------------------------------


def quality_flags(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns({"url_class": urls.classify_url(F.col("url")), "title_bad": urls.title_denied(F.col("title"))})


def quality_keep(candidates: DataFrame) -> DataFrame:
    """The candidates that neither their path nor their title rules out."""
    return quality_flags(candidates).filter("url_class != 'marketing' and not title_bad").drop("url_class", "title_bad")


def quality_report(flagged: DataFrame) -> DataFrame:
    """Counts by query: input, kept, and those each reason would drop; listings count among the kept."""
    kept = (F.col("url_class") != "marketing") & ~F.col("title_bad")
    return flagged.groupBy("query_id").agg(
        F.count("*").alias("input"), F.count_if(kept).alias("kept"), F.count_if(F.col("url_class") == "marketing").alias("denied_path"), F.count_if("title_bad").alias("denied_title"),
        F.count_if(kept & (F.col("url_class") == "company_careers_listing")).alias("listings"),
    )


def title_for_match(title: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces, a space at either end."""
    plain = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[.,/()&;:!?'\"]", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[ \t\n\r\f\x0B]+", " ")), F.lit(" "))


def contradicts_seniority(title: Column, want: Column) -> Column:
    t, w = title_for_match(title), F.lower(F.trim(want))
    holds = lambda tokens: F.exists(F.array(*[F.lit(x) for x in tokens]), lambda x: t.contains(x))
    return F.coalesce(F.when(w.isin(dims.WANT_JUNIOR), holds(dims.SENIOR_TOKENS)).when(w.isin(dims.WANT_SENIOR), holds(dims.JUNIOR_TOKENS)), F.lit(False))


def seniority_filter(candidates: DataFrame, want_col: str = "seniority", title_col: str = "title") -> DataFrame:
    return candidates.filter(~contradicts_seniority(F.col(title_col), F.col(want_col)))


def hide_companies(scored: DataFrame, hidden: DataFrame) -> DataFrame:
    """Rows (owner, url, ...) whose company the owner has not hidden; rows without a company stay."""
    keyed = scored.withColumn("hide_company", F.lower(urls.company_from_url(F.col("url"))))
    gone = hidden.select("owner", F.col("company").alias("hide_company")).distinct()
    return keyed.join(gone, ["owner", "hide_company"], "left_anti").drop("hide_company")


def order_results(scored: DataFrame, newest: bool = False, fresh_only: bool = False, as_of: Column | None = None, page: int = 25) -> DataFrame:
    """Adds place and page: by score and position, or newest first with undated rows last."""
    if fresh_only:
        from ..functions.freshness import within_days

        scored = scored.filter(within_days(F.col("published_at"), as_of))
    keys = [F.desc_nulls_last("published_at"), F.col("pos")] if newest else [F.desc("score"), F.col("pos")]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys))).withColumn("page", F.ceil(F.col("place") / page).cast("int"))
