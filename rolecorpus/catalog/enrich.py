"""Checks of the column jobs over postings and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import freshness, geo, salary, text, urls
from .base import AS_OF_S, dims, duck, logical, now, query, read, seconds, sql_content, sql_values

_POSTINGS = duck("postings")
_WS = r"[ \t\n\r\f\x0B]+"


def _duck_text(html: str) -> str:
    x = f"regexp_replace(regexp_replace({html}, '<style.*?</style>', '', 'gis'), '<script.*?</script>', '', 'gis')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


@query(f"SELECT page_id, {_duck_text('html')} AS body FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


_FLAG_TEXT = "CASE id % 4 WHEN 0 THEN 'This role is Remote. ' WHEN 1 THEN 'Work on-site daily. ' WHEN 2 THEN 'In office three days. ' ELSE '' END || description"
_SAID = "CASE WHEN regexp_matches(w, '\\bremote\\b') THEN true WHEN regexp_matches(w, '\\bon[- ]?site\\b|\\bin[- ]?office\\b') THEN false END"


@query(f"""{_POSTINGS}, t AS (SELECT id, is_remote AS flag, lower(coalesce(location_raw, '') || ' ' || substr({_FLAG_TEXT}, 1, 800)) AS w FROM postings)
SELECT id, {_SAID} AS by_text, coalesce(flag, {_SAID}) AS trusted, CASE WHEN flag THEN true WHEN NOT flag THEN regexp_matches(w, '\\bremote\\b') ELSE {_SAID} END AS doubted FROM t""")
def remote_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.when(F.col("id") % 4 == 0, "This role is Remote. ").when(F.col("id") % 4 == 1, "Work on-site daily. ").when(F.col("id") % 4 == 2, "In office three days. ").otherwise(""), "description")
    place, flag = F.col("location_raw"), F.col("is_remote")
    return logical(spark, sf_dir, "postings").select("id", text.remote_flag(place, said).alias("by_text"), text.remote_flag(place, said, flag).alias("trusted"), text.remote_flag(place, said, flag, false_is_final=False).alias("doubted"))


@query(f"""{_POSTINGS}, n AS (SELECT * FROM {sql_values(dims.LOCATION_NORM.items(), 'k, canonical')})
SELECT id, coalesce(n.canonical, location_raw) AS location FROM postings LEFT JOIN n ON n.k = trim(regexp_replace(trim(lower(location_raw)), '{_WS}', ' ', 'g'))""")
def normalize_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical(spark, sf_dir, "postings").select("id", geo.normalize_location(F.col("location_raw")).alias("location"))


_LABELLED = "'We hire. ' || CASE id % 5 WHEN 0 THEN 'Location: ' WHEN 1 THEN 'Based in - ' WHEN 2 THEN 'office – ' WHEN 3 THEN 'Working from: ' ELSE 'Somewhere ' END || coalesce(location_raw, 'Zürich') || '. Apply now'"


@query(f"""{_POSTINGS} SELECT id, nullif(trim(regexp_extract({_LABELLED}, '(?i)(?:Location|Based in|Office|Working from)\\s*[:\\-–—]\\s*(\\p{{L}}[\\p{{L}}\\p{{N}} ,/&-]{{1,60}})', 1)), '') AS found FROM postings""")
def extract_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id") % 5
    said = F.concat(F.lit("We hire. "), F.when(n == 0, "Location: ").when(n == 1, "Based in - ").when(n == 2, "office – ").when(n == 3, "Working from: ").otherwise("Somewhere "), F.coalesce("location_raw", F.lit("Zürich")), F.lit(". Apply now"))
    return logical(spark, sf_dir, "postings").select("id", geo.extract_location(said).alias("found"))


@query(f"""{duck('salary_text')}, m AS (SELECT id, regexp_extract(text, '[$€£]\\s*(\\d+(?:,\\d{{3}})*)\\s*(k|K)?(?:\\s*(?:-|–|—|to)\\s*[$€£]?\\s*(\\d+(?:,\\d{{3}})*)\\s*(k|K)?)?', ['a', 'ak', 'b', 'bk']) AS g,
  nullif(regexp_extract(text, '[$€£]\\s*(\\d+(?:,\\d{{3}})*)\\s*(k|K)?(?:\\s*(?:-|–|—|to)\\s*[$€£]?\\s*(\\d+(?:,\\d{{3}})*)\\s*(k|K)?)?', 0), '') AS raw FROM salary_text)
SELECT id, CAST(nullif(replace(g.a, ',', ''), '') AS DOUBLE) * CASE WHEN g.ak <> '' THEN 1000 ELSE 1 END AS low, CAST(nullif(replace(g.b, ',', ''), '') AS DOUBLE) * CASE WHEN g.bk <> '' THEN 1000 ELSE 1 END AS high, raw FROM m""")
def salary_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = logical(spark, sf_dir, "salary_text").withColumn("s", salary.extract_salary(F.col("text")))
    return s.select("id", F.col("s.min").alias("low"), F.col("s.max").alias("high"), F.col("s.raw").alias("raw"))


@query(f"""{duck('salary_text')}, t AS (SELECT *, id % 50 + 5 AS n FROM salary_text),
m AS (SELECT id, nullif(regexp_extract(text, '[$€£]\\s*(\\d+(?:,\\d{{3}})*)\\s*(k|K)?(?:\\s*(?:-|–|—|to)\\s*[$€£]?\\s*(\\d+(?:,\\d{{3}})*)\\s*(k|K)?)?', 0), '') AS raw,
  regexp_extract(text, '[$€£]\\s*(\\d+(?:,\\d{{3}})*)\\s*(k|K)?(?:\\s*(?:-|–|—|to)\\s*[$€£]?\\s*(\\d+(?:,\\d{{3}})*)\\s*(k|K)?)?', ['a', 'ak', 'b', 'bk']) AS g FROM salary_text)
SELECT t.id, CASE WHEN t.id % 3 < 2 THEN floor(n * 100000 * {dims.INR_TO_USD}e0 + 0.5) ELSE CAST(nullif(replace(g.a, ',', ''), '') AS DOUBLE) * CASE WHEN g.ak <> '' THEN 1000 ELSE 1 END END AS low,
  CASE t.id % 3 WHEN 1 THEN floor((n + 4) * 100000 * {dims.INR_TO_USD}e0 + 0.5) WHEN 2 THEN CAST(nullif(replace(g.b, ',', ''), '') AS DOUBLE) * CASE WHEN g.bk <> '' THEN 1000 ELSE 1 END END AS high,
  CASE t.id % 3 WHEN 0 THEN n || ' LPA' WHEN 1 THEN '₹' || n || '-' || (n + 4) || ' lakh' ELSE raw END AS raw FROM t JOIN m USING (id)""")
def salary_inr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rupee amounts in texts made from the postings' numbers; unit tests hold the examples."""
    n = F.col("id") % 50 + 5
    said = F.when(F.col("id") % 3 == 0, F.format_string("CTC %d LPA", n)).when(F.col("id") % 3 == 1, F.format_string("₹%d-%d lakh", n, n + 4)).otherwise(F.col("text"))
    s = logical(spark, sf_dir, "salary_text").select("id", salary.salary(said).alias("s"))
    return s.select("id", F.col("s.min").alias("low"), F.col("s.max").alias("high"), F.col("s.raw").alias("raw"))


@query(f"""{_POSTINGS}, t AS (SELECT id, CASE WHEN id % 7 <> 0 THEN CAST(1000 * (id % 90) AS DOUBLE) END AS lo, CASE WHEN id % 5 <> 0 THEN CAST(2000 * (id % 90) AS DOUBLE) END AS hi FROM postings)
SELECT id, CASE WHEN id % 3 <> 0 AND (lo IS NOT NULL OR hi IS NOT NULL) THEN lo END AS c_low, CASE WHEN id % 3 <> 0 AND (lo IS NOT NULL OR hi IS NOT NULL) THEN hi END AS c_high,
  CASE WHEN id % 4 <> 1 THEN CASE WHEN id % 2 = 0 THEN floor(lo * 0.012 + 0.5) ELSE lo END END AS a_low, CASE WHEN id % 4 <> 1 THEN CASE WHEN id % 2 = 0 THEN floor(hi * 0.012 + 0.5) ELSE hi END END AS a_high FROM t""")
def structured_salary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    lo, hi = F.when(n % 7 != 0, (1000 * (n % 90)).cast("double")), F.when(n % 5 != 0, (2000 * (n % 90)).cast("double"))
    part = lambda currency, a, b: F.struct(F.lit("s").alias("summary"), currency.alias("currencyCode"), a.alias("min"), b.alias("max"))
    components = F.array(part(F.lit("EUR"), F.lit(1.0), F.lit(2.0)), part(F.when(n % 3 == 0, "EUR").otherwise("USD"), lo, hi))
    t = logical(spark, sf_dir, "postings").select("id", salary.component_salary(components, F.lit(None).cast("string")).alias("c"), salary.aggregator_salary(lo, hi, (n % 4 == 1).cast("int"), F.when(n % 2 == 0, "in").otherwise("us")).alias("a"))
    return t.select("id", F.col("c.min").alias("c_low"), F.col("c.max").alias("c_high"), F.col("a.min").alias("a_low"), F.col("a.max").alias("a_high"))


@query(f"{_POSTINGS} SELECT id, sha256(lower(trim(coalesce(title, ''))) || '|' || lower(coalesce(company, '')) || '|' || lower(coalesce(location_raw, ''))) AS dedup_key FROM postings")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical(spark, sf_dir, "postings").select("id", text.dedup_key(F.col("title"), F.col("company"), F.col("location_raw")).alias("dedup_key"))


_HOST = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"
_PATH = r"regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^/[a-z]{2}(-[a-zA-Z]{2})?/', '/')"


def _duck_company(h: str, p0: str) -> str:
    return f"""nullif(CASE WHEN {h} LIKE '%greenhouse.io' OR {h} IN ('jobs.lever.co', 'jobs.ashbyhq.com', 'apply.workable.com', 'jobs.smartrecruiters.com') THEN {p0}
  WHEN {h} LIKE '%.myworkdayjobs.com' OR {h} LIKE '%.bamboohr.com' OR {h} LIKE '%.recruitee.com' OR {h} LIKE '%.teamtailor.com' THEN split_part({h}, '.', 1) ELSE {p0} END, '')"""


_FIRST = "regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)', 1)"


@query(f"{_POSTINGS}, t AS (SELECT id, {_HOST} AS h, {_FIRST} AS p0 FROM postings) SELECT id, {_duck_company('h', 'p0')} AS company FROM t")
def company_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical(spark, sf_dir, "postings").select("id", urls.company_from_url(F.col("url")).alias("company"))


_CANONICAL = r"lower(regexp_replace(regexp_replace(regexp_replace({u}, '[?#].*$', ''), '^(https?://[^/]+)/[a-z]{{2}}(-[a-zA-Z]{{2}})?/', '\1/'), '/$', ''))"


@query(f"SELECT page_id, {_CANONICAL.format(u='url')} AS canonical FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


def _duck_class(h: str, p: str) -> str:
    rules = []
    for _, tests, pattern in dims.JOB_URL_RULES:
        hosts = " OR ".join(f"{h} LIKE '%{t}'" if t.startswith(".") else f"{h} = '{t}'" for t in tests)
        rules.append(f"WHEN {hosts} THEN CASE WHEN regexp_matches({p}, '{pattern}') THEN 'individual_job' ELSE 'company_careers_listing' END")
    denied = " OR ".join(f"contains(lower({p}), '{x}')" for x in dims.DENY_PATHS)
    vendor = " OR ".join(f"({h} = '{x}' AND starts_with({p}, '{y}'))" for x, y in dims.VENDOR_CAREERS)
    return f"CASE WHEN {h} = '' THEN 'unknown' WHEN {denied} OR {vendor} THEN 'marketing' {' '.join(rules)} ELSE 'unknown' END"


@query(f"{_POSTINGS}, t AS (SELECT id, {_HOST} AS h, {_PATH} AS p FROM postings) SELECT id, {_duck_class('h', 'p')} AS url_class FROM t")
def classify_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical(spark, sf_dir, "postings").select("id", urls.classify_url(F.col("url")).alias("url_class"))


_DENIED = f"((regexp_matches(title, '{dims.VENDOR_SUFFIX}') AND NOT regexp_matches(title, '{dims.ROLE_TOKENS}')) OR regexp_matches(title, '{dims.AUTHOR_TITLE}') OR regexp_matches(title, '{dims.EXPIRED_TITLE}'))"


@query(f"{_POSTINGS} SELECT id, {_DENIED} AS denied FROM postings")
def title_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical(spark, sf_dir, "postings").select("id", urls.title_denied(F.col("title")).alias("denied"))


_HINTED = "CASE id % 4 WHEN 0 THEN '{\"@type\": \"JobPosting\"}' WHEN 1 THEN '{\"@type\":[\"Thing\",\"JobPosting\"]}' WHEN 2 THEN '<div itemtype=\"https://schema.org/JobPosting\">' ELSE title END"


@query(_POSTINGS + f", t AS (SELECT id, {_HINTED} AS x FROM postings) SELECT id, " + " OR ".join("regexp_matches(x, '" + h.replace("'", "''") + "')" for h in dims.SCHEMA_HINTS) + " AS hinted FROM t")
def jobposting_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id") % 4
    x = F.when(n == 0, '{"@type": "JobPosting"}').when(n == 1, '{"@type":["Thing","JobPosting"]}').when(n == 2, '<div itemtype="https://schema.org/JobPosting">').otherwise(F.col("title"))
    return logical(spark, sf_dir, "postings").select("id", urls.has_jobposting_schema(x).alias("hinted"))


@query(f"""{_POSTINGS}, t AS (SELECT id % 20 AS query_id, {_duck_class(_HOST, _PATH)} AS c, {_DENIED} AS d FROM postings)
SELECT query_id, count(*) AS input, count(*) FILTER (c <> 'marketing' AND NOT d) AS kept, count(*) FILTER (c = 'marketing') AS denied_path, count(*) FILTER (d) AS denied_title,
  count(*) FILTER (c = 'company_careers_listing' AND NOT d) AS listings FROM t GROUP BY query_id""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import quality_flags, quality_report

    return quality_report(quality_flags(logical(spark, sf_dir, "postings").withColumn("query_id", F.col("id") % 20)))


def _duck_city_rows() -> str:
    return sql_values([(k, c, cc, dims.normalized(s)) for k, (c, cc, syn) in enumerate(dims.CITIES) for s in syn if "," not in s], "pos, city, country, token")


_TAGS = f"""c AS (SELECT * FROM {_duck_city_rows()}), hits AS (SELECT DISTINCT id, pos, city, country FROM postings JOIN c ON contains(' ' || {sql_content('location_raw')} || ' ', ' ' || token || ' '))"""


@query(f"{_POSTINGS}, {_TAGS} SELECT p.id, coalesce(list(city ORDER BY pos) FILTER (city IS NOT NULL), []) AS cities FROM postings p LEFT JOIN hits h ON h.id = p.id GROUP BY p.id")
def tag_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical(spark, sf_dir, "postings").select("id", F.coalesce(geo.tag_cities(F.col("location_raw")), F.array()).alias("cities"))


@query(f"""{_POSTINGS.replace('WITH ', 'WITH ' + duck('queries')[5:] + ', ')}, {_TAGS},
q AS (SELECT query_id, location, {sql_content('location')} AS n FROM queries),
t AS (SELECT query_id, token FROM q JOIN c ON c.city IN (SELECT city FROM c c2 WHERE contains(' ' || q.n || ' ', ' ' || c2.token || ' ')) UNION
  SELECT query_id, lower(trim(location)) FROM q WHERE location IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE contains(' ' || q.n || ' ', ' ' || c.token || ' ')))
SELECT q.query_id, p.location_raw AS place, count(*) AS n FROM q JOIN postings p ON coalesce(trim(p.location_raw), '') <> '' AND EXISTS (SELECT 1 FROM t WHERE t.query_id = q.query_id AND contains(' ' || {sql_content('p.location_raw')} || ' ', ' ' || t.token || ' ')) GROUP BY 1, 2
UNION ALL SELECT query_id, NULL, (SELECT count(*) FROM postings) FROM q WHERE location IS NULL""")
def location_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query against the distinct places of the corpus."""
    queries = geo.location_terms(logical(spark, sf_dir, "queries")).select("query_id", "loc_terms")
    postings = logical(spark, sf_dir, "postings").select("id", "location_raw")
    from ..operators.retrieval import match_locations

    return match_locations(queries, postings)


@query(f"""{_POSTINGS}, {_TAGS}, a AS (SELECT * FROM {sql_values(dims.COUNTRY_ALIASES.items(), 'alias, country')})
SELECT p.id, CASE WHEN trim(location_raw) <> '' THEN coalesce(any_value(a.country), arg_min(h.country, h.pos)) END AS country FROM postings p
LEFT JOIN a ON a.alias = {sql_content('p.location_raw')} LEFT JOIN hits h ON h.id = p.id GROUP BY p.id, location_raw""")
def country_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical(spark, sf_dir, "postings").select("id", geo.country_code(F.col("location_raw")).alias("country"))


@query(f"""{_POSTINGS}, {_TAGS} SELECT p.id, contains(' ' || {sql_content('p.location_raw')} || ' ', ' india ') OR {sql_content('p.location_raw')} IN ('india', 'bharat', 'in') OR EXISTS (SELECT 1 FROM hits WHERE hits.id = p.id AND country = 'IN') AS flagged FROM postings p""")
def country_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical(spark, sf_dir, "postings").select("id", geo.country_flag(F.col("location_raw")).alias("flagged"))


_ISO = "CASE id % 3 WHEN 0 THEN '2024-02-03T04:05:06Z' WHEN 1 THEN '2024-02-03' ELSE 'soon' END"


@query(f"{_POSTINGS} SELECT id, epoch(TRY_CAST(replace({_ISO}, 'Z', '') AS TIMESTAMP))::BIGINT AS iso_s, CAST(floor((published_s * 1000 + 7) / 1000) AS BIGINT) AS ms_s FROM postings")
def published_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id") % 3
    iso = F.when(n == 0, "2024-02-03T04:05:06Z").when(n == 1, "2024-02-03").otherwise("soon")
    return logical(spark, sf_dir, "postings").select("id", seconds(freshness.published_at(iso=iso)).alias("iso_s"), seconds(freshness.published_at(epoch_ms=F.col("published_s") * 1000 + 7)).alias("ms_s"))


@query(r"SELECT doc_id, regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.-]+', '<email>', 'g') AS clean FROM documents")
def scrub_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.scrub_text(F.col("text")).alias("clean"))


_D = f"CASE WHEN published_s IS NOT NULL THEN CAST(floor(greatest({AS_OF_S} - published_s, 0) / 86400) AS BIGINT) END"


@query(f"""{_POSTINGS}, t AS (SELECT *, {_D} AS d, ({AS_OF_S} - published_s) / 86400.0e0 AS age, ({AS_OF_S} - last_seen_s) / 86400.0e0 AS seen, CAST(floor(({AS_OF_S} - published_s) / 60) AS BIGINT) AS m FROM postings)
SELECT id, d AS days, CASE WHEN d < 7 THEN 'fresh' WHEN d < 21 THEN 'recent' WHEN d < 60 THEN 'aging' WHEN d < 120 THEN 'stale' WHEN d IS NOT NULL THEN 'ancient' END AS tier,
  CASE WHEN d = 0 THEN 'today' WHEN d < 7 THEN d || 'd ago' WHEN d < 30 THEN CAST(floor(d / 7) AS BIGINT) || 'w ago' WHEN d < 365 THEN CAST(floor(d / 30) AS BIGINT) || 'mo ago' WHEN d IS NOT NULL THEN CAST(floor(d / 365) AS BIGINT) || 'y ago' END AS label,
  coalesce(age >= 0 AND age < 7, false) AS this_week, CASE WHEN age >= 7 AND seen <= 7 THEN CASE WHEN seen < 1 THEN 'Still listed today' ELSE 'Listed ' || CAST(floor(seen) AS BIGINT) || 'd ago' END END AS listed,
  CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN CAST(floor(m / 60) AS BIGINT) || 'h ago' WHEN m < 43200 THEN CAST(floor(m / 1440) AS BIGINT) || 'd ago' WHEN m IS NOT NULL THEN CAST(floor(m / 43200) AS BIGINT) || 'mo ago' END AS relative FROM t""")
def freshness_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, seen = F.col("published_at"), F.col("last_seen_at")
    return logical(spark, sf_dir, "postings").select(
        "id", freshness.age_days(at, now()).alias("days"), freshness.freshness_tier(at, now()).alias("tier"), freshness.freshness_label(at, now()).alias("label"),
        freshness.within_days(at, now()).alias("this_week"), freshness.still_listed(at, seen, now()).alias("listed"), freshness.relative_time(at, now()).alias("relative"),
    )


@query(f"""{duck('scores')} SELECT id, CASE WHEN score >= 0.85 THEN 'strong' WHEN score >= 0.65 THEN 'good' WHEN score >= 0.4 THEN 'fair' END AS band, CASE WHEN score >= 0.4 THEN CAST(floor(score * 100 + 0.5) AS BIGINT) || '% match' END AS label,
  nullif(CASE WHEN id % 3 <> 0 THEN '$' || CAST(floor((id % 300 * 1000 + 50001) / 1000.0e0 + 0.5) AS BIGINT) || 'k' ELSE '' END || CASE WHEN id % 3 <> 0 AND id % 4 <> 0 THEN '–' ELSE '' END || CASE WHEN id % 4 <> 0 THEN '$' || CAST(floor((id % 300 * 1000 + 90501) / 1000.0e0 + 0.5) AS BIGINT) || 'k' ELSE '' END, '') AS salary FROM scores""")
def display_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    low, high = F.when(n % 3 != 0, n % 300 * 1000 + 50001), F.when(n % 4 != 0, n % 300 * 1000 + 90501)
    return logical(spark, sf_dir, "scores").select("id", text.score_band(F.col("score")).alias("band"), text.score_label(F.col("score")).alias("label"), text.salary_label(low, high).alias("salary"))


def _duck_sections() -> str:
    """Blocks of documents as rows of lines, paragraphs and runs. RE2 has no lookaround: a mark behind each blank stands for a
    label's beginning, and the blank for its end."""
    mark, ascii_blank = "\uFDD2", r"[ \t\n\r\f\x0B]"
    label = "|".join(text.SECTION_LABELS).replace("'", "''").replace("[\\w &''.-]", "(?:@|[\\w&''.-])").replace("[- ]", "(?:-|@)").replace(" ", "@").replace("@", f" {mark}")
    item, inline, blank = text.ITEM, text.INLINE, text.ANY_BLANK
    return f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(translate(coalesce(replace(text, chr(10), ' Requirements: '), ''), '\u00A0\u2007\u202F\uFDD0\uFDD1', '   '), '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g') AS t FROM documents),
  labelled AS (SELECT doc_id, replace(regexp_replace(regexp_replace(t, '({ascii_blank})', '\\1{mark}', 'g'), '(^|{mark})({label}):?({ascii_blank}|$)', '\\1' || chr(10) || chr(10) || '\\2' || chr(10) || '\\3', 'g'), '{mark}', '') AS t FROM t),
  listed AS (SELECT doc_id, string_split(array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN len(regexp_split_to_array(x, '{inline}')) > 2 THEN regexp_replace(x, '{inline}', chr(10) || '• ', 'g') ELSE x END), chr(10)), chr(10)) AS l FROM labelled),
  lines AS (SELECT doc_id, unnest(range(len(l))) AS n, regexp_replace(unnest(l), '^{blank}+|{blank}+$', '', 'g') AS x FROM listed),
  placed AS (SELECT *, count(*) FILTER (x = '') OVER (PARTITION BY doc_id ORDER BY n) AS par FROM lines),
  pars AS (SELECT doc_id, par, list(x ORDER BY n) AS l, bool_and(regexp_matches(x, '{item}')) AS listed, arg_min(x, n) AS x FROM placed WHERE x <> '' GROUP BY doc_id, par),
  kinds AS (SELECT *, CASE WHEN listed AND regexp_matches(x, '^\\p{{Nd}}') THEN 'numbered' WHEN listed THEN 'bullets'
    WHEN len(l) = 1 AND (length(x) < 70 AND regexp_matches(x, '^[A-Z]') AND NOT regexp_matches(x, '[.!?]$') AND len(regexp_split_to_array(x, '{blank}+')) <= 9 OR regexp_matches(x, '^#{{1,6}}{blank}+[^\\n]')) THEN 'heading' ELSE 'paragraph' END AS kind FROM pars),
  runs AS (SELECT *, coalesce(listed AND kind = lag(kind) OVER w, false) AS goes_on FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY par)),
  blocks AS (SELECT *, count(*) FILTER (NOT goes_on) OVER (PARTITION BY doc_id ORDER BY par) - 1 AS pos FROM runs)
SELECT doc_id, pos::INTEGER AS pos, kind, CASE kind WHEN 'heading' THEN regexp_replace(any_value(x), '^#{{1,6}}{blank}+|:$', '', 'g') WHEN 'paragraph' THEN array_to_string(any_value(l), ' ') END AS text,
  CASE WHEN any_value(listed) THEN list_transform(flatten(list(l ORDER BY par)), lambda i: regexp_replace(i, '{item}', '')) END AS items FROM blocks GROUP BY doc_id, pos, kind"""


@query(_duck_sections())
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each document, every line but the first under a label."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\\n", " Requirements: ").alias("text"))
    return text.split_sections(docs, "text", ["doc_id"])


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'anon' WHEN 1 THEN 'user' ELSE 'invalid' END AS kind FROM customer""")
def owner_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    digest = F.md5(n.cast("string"))
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.upper(F.substring(digest, 21, 12)))
    key = F.when(n % 3 == 0, uuid).when(n % 3 == 1, F.concat(F.lit(" c"), F.substring(digest, 1, 24), F.lit(" "))).otherwise(F.concat(F.lit("x"), digest))
    return read(spark, sf_dir, "customer").select(n.alias("id"), text.owner_kind(key).alias("kind"))

