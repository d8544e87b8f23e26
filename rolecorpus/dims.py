"""Static dimensions and tunables. These are fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# canonical name, country, synonyms, in the order that ties are resolved
CITIES = [
    ("Bengaluru", "IN", ["Bengaluru", "Bangalore", "BLR"]),
    ("Gurugram", "IN", ["Gurugram", "Gurgaon"]),
    ("Mumbai", "IN", ["Mumbai", "Bombay"]),
    ("Delhi", "IN", ["Delhi", "New Delhi", "NCR", "Noida"]),
    ("Hyderabad", "IN", ["Hyderabad", "Hyd"]),
    ("Chennai", "IN", ["Chennai", "Madras"]),
    ("Pune", "IN", ["Pune"]),
    ("Kolkata", "IN", ["Kolkata", "Calcutta"]),
    ("Ahmedabad", "IN", ["Ahmedabad", "Amdavad"]),
    ("Jaipur", "IN", ["Jaipur"]),
    ("Kochi", "IN", ["Kochi", "Cochin"]),
    ("Indore", "IN", ["Indore"]),
    ("Coimbatore", "IN", ["Coimbatore"]),
    ("Chandigarh", "IN", ["Chandigarh", "Mohali"]),
    ("Thiruvananthapuram", "IN", ["Thiruvananthapuram", "Trivandrum"]),
    ("New York", "US", ["New York", "New York City", "NYC"]),
    ("San Francisco", "US", ["San Francisco", "SF", "Bay Area", "San Francisco Bay Area"]),
    ("Seattle", "US", ["Seattle"]),
    ("Austin", "US", ["Austin"]),
    ("Boston", "US", ["Boston"]),
    ("Los Angeles", "US", ["Los Angeles", "LA"]),
    ("Chicago", "US", ["Chicago"]),
    ("Atlanta", "US", ["Atlanta"]),
    ("Denver", "US", ["Denver"]),
    ("Washington", "US", ["Washington DC", "Washington, DC", "DC"]),
    ("London", "GB", ["London"]),
    ("Manchester", "GB", ["Manchester"]),
    ("Toronto", "CA", ["Toronto"]),
    ("Vancouver", "CA", ["Vancouver"]),
    ("Singapore", "SG", ["Singapore"]),
    ("Sydney", "AU", ["Sydney"]),
    ("Melbourne", "AU", ["Melbourne"]),
    ("Berlin", "DE", ["Berlin"]),
    ("Paris", "FR", ["Paris"]),
    ("Tokyo", "JP", ["Tokyo"]),
]
COUNTRY_ALIASES = {
    "india": "IN", "bharat": "IN", "in": "IN", "us": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "america": "US", "united states": "US",
    "uk": "GB", "u.k.": "GB", "gb": "GB", "britain": "GB", "great britain": "GB", "united kingdom": "GB", "canada": "CA", "ca": "CA", "singapore": "SG", "sg": "SG",
    "australia": "AU", "au": "AU", "germany": "DE", "de": "DE", "france": "FR", "fr": "FR", "japan": "JP", "jp": "JP",
}
LOCATION_NORM = {
    "sf": "San Francisco, CA", "san francisco": "San Francisco, CA", "bay area": "San Francisco Bay Area, CA", "nyc": "New York, NY", "new york": "New York, NY",
    "new york city": "New York, NY", "ny": "New York, NY", "la": "Los Angeles, CA", "los angeles": "Los Angeles, CA", "seattle": "Seattle, WA", "austin": "Austin, TX",
    "boston": "Boston, MA", "chicago": "Chicago, IL", "london": "London, UK", "berlin": "Berlin, Germany", "remote us": "Remote (US)", "remote eu": "Remote (EU)",
}
# board, host test (exact host, or suffix if it starts with a dot), path pattern of one posting
JOB_URL_RULES = [
    ("greenhouse", ["boards.greenhouse.io", ".greenhouse.io"], r"^/[^/]+/jobs/[0-9]+"),
    ("lever", ["jobs.lever.co"], r"(?i)^/[^/]+/[0-9a-f-]{8,}"),
    ("ashby", ["jobs.ashbyhq.com"], r"^/[^/]+/[^/]+"),
    ("workable", ["apply.workable.com"], r"^/[^/]+/j/"),
    ("smartrecruiters", ["jobs.smartrecruiters.com"], r"^/[^/]+/[0-9]+"),
    ("workday", [".myworkdayjobs.com"], r"/job/"),
    ("bamboohr", [".bamboohr.com"], r"/careers/[0-9]+"),
    ("recruitee", [".recruitee.com"], r"/o/"),
    ("teamtailor", [".teamtailor.com"], r"/jobs/"),
    ("personio", [".jobs.personio.de", "jobs.personio.de"], r"/job/"),
]
DENY_PATHS = [
    "/blog/", "/resources/", "/customers/", "/customer-stories/", "/podcast/", "/team/", "/about/", "/about-us/", "/leadership/", "/product-updates/", "/post-jobs-for-free/",
    "/job-description/", "/job-descriptions/", "/templates/", "/template/", "/author/", "/press/", "/news/", "/events/", "/webinars/", "/integrations/", "/partners/", "/case-stud",
]
VENDOR_CAREERS = [("www.bamboohr.com", "/careers"), ("bamboohr.com", "/careers"), ("www.lever.co", "/careers"), ("lever.co", "/careers")]
ROLE_TOKENS = r"(?i)engineer|developer|manager|designer|analyst|scientist|architect|lead|consultant|specialist|administrator|intern|director"
VENDOR_SUFFIX = r"(?i)\|\s*(SmartRecruiters|Lever|BambooHR|Teamtailor|Greenhouse)\s*$"
AUTHOR_TITLE = r"(?i)Author at "
EXPIRED_TITLE = r"(?i)job ad has expired|no longer (accepting|available)"
SCHEMA_HINTS = [r'(?i)"@type"\s*:\s*"JobPosting"', r'(?i)"@type"\s*:\s*\[[^\]]*"JobPosting"', r"(?i)itemtype=[\"']https?://schema\.org/JobPosting[\"']"]
TENANT_DENYLIST = [
    ("lever", "leverdemo-8"), ("lever", "leverdemo"), ("greenhouse", "greenhousedemo"), ("greenhouse", "demo"), ("ashby", "ashby"),
    ("smartrecruiters", "oneclick-ui"), ("smartrecruiters", "smart4talent1"), ("smartrecruiters", "dev2"), ("smartrecruiters", "smartrecruiters"),
]
SENIOR_TOKENS = ["principal", "staff", "lead", "director", "vp ", "vice president", "head of", "senior", " sr "]
JUNIOR_TOKENS = ["junior", "associate", "intern", "entry level", "new grad", "graduate", " i ", " 1 "]
WANT_JUNIOR = ["junior", "intern", "entry", "entry-level", "associate"]
WANT_SENIOR = ["senior", "staff", "principal", "lead", "director", "vp", "c-suite"]
FILLER_WORDS = ["role", "roles", "job", "jobs", "in", "for", "with", "of", "year", "years", "yr", "yrs", "experience", "exp", "and", "or", "the", "a", "an", "to", "at", "remote"]
FILTER_TRIGGERS = (
    r"(?i)\b(remote|senior|junior|staff|lead|manager|director|vp|c-suite|intern|mid|level|eu|us|uk|india|canada|australia|nyc|sf|berlin|london|paris|tokyo|singapore|toronto|sydney|"
    r"fintech|crypto|blockchain|no |exclude|avoid|this (week|month|year)|last (24h|week|month)|posted|salary|\$\d|k\+|remote-first|work from|based in)\b"
)
INTERACTION_KINDS = ["saved", "hidden", "applied", "dismissed"]

STORE_TTL_HOURS = 6
MIN_SCORE = 0.4
TOP_K = 50
FALLBACK_BELOW = 5
SCORE_BATCH = 15
SCORE_TEXT_CHARS = 200
STORE_PURGE_DAYS = 7
ANON_RETENTION_DAYS = 30
FRESH_DAYS = 7
INR_TO_USD = 0.012
LLM_USD_PER_1K = 0.0014
SEARCH_USD = 0.005
#: Words that neither the term index nor queries keep.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def normalized(value: str) -> str:
    """Lower case, anything but letters and digits to single spaces."""
    import re

    return re.sub(r"[^a-z0-9]+", " ", value.lower()).strip()


def cities(spark: SparkSession) -> DataFrame:
    """(city_pos, city, country, synonym, token): a row per synonym; 35 cities, so always small."""
    rows = [(k, c, cc, s, normalized(s)) for k, (c, cc, syn) in enumerate(CITIES) for s in syn]
    return spark.createDataFrame(rows, "city_pos int, city string, country string, synonym string, token string")


def denylist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TENANT_DENYLIST, "ats string, slug string")
