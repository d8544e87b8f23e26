"""Column functions on pinned examples."""

import random
import re
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from rolecorpus.queries import ORACLES
from rolecorpus.functions import freshness, geo, salary, text, urls


#: What the query does to its texts before they are parted.
LINES_TO_LABELS = "replace(text, chr(10), ' Requirements: ')"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("said", "low", "high"),
    [("12 LPA", 14400, None), ("₹15-25 LPA", 18000, 30000), ("8L - 14L", 9600, 16800), ("Rs 1.5 crore", 180000, None), ("$120k - $180k", 120000, 180000), ("Salary: $200,000 per year", 200000, None), ("no amount", None, None)],
)
def test_salary(spark, said, low, high):
    got = one(spark, salary.salary(F.col("t")), t=said)
    assert (got["min"], got["max"]) == (low, high)


def test_salary_keeps_the_longest_annual_amount(spark):
    assert one(spark, salary.extract_salary(F.col("t")), t="fee $5 then $90k then $100,000 - $120,000 a year")["min"] == 100000
    assert one(spark, salary.extract_salary(F.col("t")), t="120-180k or $120-180k")["min"] == 120


@pytest.mark.parametrize(("said", "want"), [("Based in: San Francisco, CA. Remote ok.", "San Francisco, CA"), ("Office: Zürich", "Zürich"), ("nothing here", None)])
def test_extract_location(spark, said, want):
    assert one(spark, geo.extract_location(F.col("t")), t=said) == want


def test_cities_countries_and_matches(spark):
    assert one(spark, geo.tag_cities(F.col("t")), t="roles in Bombay and BLR") == ["Bengaluru", "Mumbai"]
    assert one(spark, geo.country_code(F.col("t")), t="U.K.") is None and one(spark, geo.country_code(F.col("t")), t="Berlin office") == "DE"
    q = geo.location_terms(spark.createDataFrame([("Gurugram",), ("Pune",), (None,), ("Remote, EU",)], "location string"))
    pairs = {(r["location"], p): r["m"] for p in ("Gurgaon, HR", "Mumbai, India", None) for r in q.select("location", geo.location_matches(F.lit(p), F.col("loc_terms")).alias("m")).collect()}
    assert pairs["Gurugram", "Gurgaon, HR"] and not pairs["Pune", "Mumbai, India"] and not pairs["Pune", None] and pairs[None, None] and not pairs["Remote, EU", "Mumbai, India"]


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        ("https://boards.greenhouse.io/acme/jobs/123", "individual_job"), ("https://boards.greenhouse.io/acme", "company_careers_listing"), ("https://jobs.lever.co/acme/0a1b2c3d-4e5f", "individual_job"), ("https://x.example/de/about-us/team", "marketing"),
        ("https://www.lever.co/careers/", "marketing"), ("https://acme.myworkdayjobs.com/en-US/board/job/x", "individual_job"), ("https://example.org/role", "unknown"), ("not a url", "unknown"), ("https://apply.workable.com/acme/j/AB12/", "individual_job"),
    ],
)
def test_classify_url(spark, url, kind):
    assert one(spark, urls.classify_url(F.col("u")), u=url) == kind


@pytest.mark.parametrize(
    ("url", "company"),
    [("https://boards.greenhouse.io/embed/job_board?for=acme", "acme"), ("https://jobs.lever.co/acme/1", "acme"), ("https://acme.wd1.myworkdayjobs.com/x", None), ("https://acme.bamboohr.com/careers/1", "acme"), ("https://a.acme.teamtailor.com/jobs/1", "acme"), ("https://careers.smartrecruiters.com/careers", "careers"), ("https://example.org/x", None)],
)
def test_company(spark, url, company):
    assert one(spark, urls.company_from_url(F.col("u")), u=url) == company


def test_canonical_url_and_tenant(spark):
    assert one(spark, urls.canonical_url(F.col("u")), u="https://X.example/en-us/Jobs/1/?a=b#c") == "https://x.example/jobs/1"
    assert one(spark, urls.canonical_url(F.col("u")), u="bad url?x") == "bad url"
    assert tuple(one(spark, urls.tenant_from_url(F.col("u")), u="https://api.lever.co/v0/postings/%40Acme")) == ("lever", "acme")
    assert one(spark, urls.tenant_from_url(F.col("u")), u="https://example.org/x") is None


def test_titles(spark):
    bad = ["Jane Roe | SmartRecruiters", "Tips — Author at Lever", "This job ad has expired"]
    good = ["Software Engineer | SmartRecruiters", "Authoring tools developer"]
    assert all(one(spark, urls.title_denied(F.col("t")), t=t) for t in bad) and not any(one(spark, urls.title_denied(F.col("t")), t=t) for t in good)


def test_freshness(spark):
    at = lambda s: F.to_timestamp(F.lit(s))
    now = at("2024-01-15 12:00:00")
    assert not one(spark, freshness.within_days(at("2024-01-08 12:00:00"), now)) and one(spark, freshness.within_days(at("2024-01-08 12:00:01"), now))
    assert one(spark, freshness.freshness_tier(at("2024-02-01 00:00:00"), now)) == "fresh" and not one(spark, freshness.within_days(at("2024-02-01 00:00:00"), now))
    assert one(spark, freshness.age_days(F.lit(None).cast("timestamp"), now)) is None


def test_text(spark):
    assert one(spark, text.html_to_text(F.col("t")), t="<style>x</style><p>a&amp;lt;b&nbsp;&lt;i&gt;</p><SCRIPT>y</SCRIPT>c") == "a<b <i> c"
    assert one(spark, text.html_to_text(F.col("t"), True), t="&lt;p&gt;hi&lt;/p&gt;") == "hi"
    assert one(spark, text.scrub_map(F.create_map(F.lit("rawQuery"), F.lit("x"), F.lit("note"), F.lit("to a.b@c.de now")))) == {"rawQuery": "<redacted>", "note": "to <email> now"}
    assert one(spark, text.slug_to_name(F.col("t")), t="big-aI-co") == "Big AI Co"
    assert one(spark, text.free_text_remote(F.col("t")), t="remote - Europe") and not one(spark, text.free_text_remote(F.col("t")), t="remote")


# ---- sections, plainly ------------------------------------------------------------------------------------

ITEM_AT = re.compile(r"(?:[*\-•◦▪●·‣⁃]|\d+[.)])\s+")
INLINE_AT = re.compile(r"\s+[•◦▪●‣⁃]\s+")
LABEL_AT = re.compile(rf"(?<!\S)({'|'.join(text.SECTION_LABELS)}):?(?!\S)", re.ASCII)


def _section_lines(said: str):
    """The lines of a description, a blank one and a line of its own for each label, and a line for each item of an
    inline list."""
    plain = re.sub(r"[ \t]+\n", "\n", re.sub(r"\r\n?", "\n", said).translate({0xA0: " ", 0x2007: " ", 0x202F: " "}))
    for k, piece in enumerate(LABEL_AT.split(plain)):
        if k % 2:  # a label; what follows it is of its paragraph
            yield ""
            yield piece
            continue
        for line in piece.split("\n"):
            first, *more = INLINE_AT.split(line)
            if len(more) > 1:
                yield from (first, *(f"• {x}" for x in more))
            else:
                yield line


def _line_kind(lines: list[str]) -> str:
    if all(ITEM_AT.match(x) for x in lines):
        return "numbered" if lines[0][0].isdigit() else "bullets"
    only = lines[0]
    named = len(only) < 70 and only[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and only[-1] not in ".!?" and len(only.split()) <= 9
    return "heading" if len(lines) == 1 and (named or re.match(r"#{1,6}\s+.", only)) else "paragraph"


def sections_of(said: str | None):
    """Ordered blocks of a description: headings, paragraphs, bullet lists and numbered lists. Lines between blank ones
    are classified together; neighbouring lists of one kind are one list."""
    stripped = (x.strip() for x in _section_lines(said or ""))
    paragraphs = [list(g) for filled, g in groupby(stripped, key=bool) if filled]
    listed = {"bullets", "numbered"}
    runs = groupby(enumerate((_line_kind(x), x) for x in paragraphs), key=lambda p: (p[1][0], None if p[1][0] in listed else p[0]))
    for pos, ((kind, _), run) in enumerate(runs):
        lines = [x for _, (_, own) in run for x in own]
        if kind in listed:
            yield pos, kind, None, [ITEM_AT.sub("", x, count=1).strip() for x in lines]
        elif kind == "heading":
            yield pos, kind, re.sub(r"^#{1,6}\s+|:$", "", lines[0]), None
        else:
            yield pos, kind, " ".join(lines), None


def sections_in(spark, *texts):
    rows = text.split_sections(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", ["id"]).orderBy("id", "pos").collect()
    return [[(r.pos, r.kind, r.text, r["items"]) for r in rows if r.id == k] for k in range(len(texts))]


def test_sections(spark):
    said = "Intro text here. Requirements: • React • SQL • Go\n\n1. first\n2) second\n\n## Title:\n\nLast words."
    got, none = sections_in(spark, said, None)
    kinds = [(k, t, i) for _, k, t, i in got]
    assert kinds[0] == ("paragraph", "Intro text here.", None) and ("bullets", None, ["React", "SQL", "Go"]) in kinds
    assert ("numbered", None, ["first", "second"]) in kinds and ("heading", "Title", None) in kinds and kinds[-1] == ("paragraph", "Last words.", None) and not none


def test_section_labels_of_every_kind(spark):
    said = "Intro. Why You'll Love Acme it is good\n\nTechnical Requirements\n* a\n* b\n\n1. one\n\nDay-to-Day: work\n\nDiversity and Inclusion"
    got = [(k, t or i) for _, k, t, i in sections_in(spark, said)[0]]
    assert got == [("paragraph", "Intro."), ("paragraph", "Why You'll Love Acme it is good"), ("heading", "Technical Requirements"), ("bullets", ["a", "b"]), ("numbered", ["one"]), ("paragraph", "Day-to-Day work"), ("heading", "Diversity and Inclusion")]


def test_sections_against_plain_python_and_sql(spark):
    """Random texts of labels, marks and blanks of all kinds: the columns, a line-by-line version and the SQL agree."""
    rng = random.Random(5)
    bits = [*"\n\n\n    \t\r", "\r\n", "\u00a0", "\u2003", "\x0b", "\x1f", "\x85", "\u2028", "• ", " • ", "- ", "* ", "1. ", "٣) ", "# ", "## ", ":", ".", "Requirements", "Requirements: ", " Requirements ", "About Acme & Co", "What you’ll do", "Day to Day", "Must-haves", "Job Description", "Word", "word", "a longer run of small words", "Ünïcode", "Our Team", "Nice to have"]
    texts = ["", " \n ", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500))]
    got = sections_in(spark, *texts)
    assert got == [list(sections_of(x)) for x in texts]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [[k, x] for k, x in enumerate(texts)])
    rows = con.execute(f"SELECT doc_id, pos, kind, text, items FROM ({ORACLES['sections'].replace(LINES_TO_LABELS, 'text')}) ORDER BY 1, 2").fetchall()
    assert rows == [(k, *r) for k, own in enumerate(got) for r in own]


def test_rupee_amounts():
    pins = {
        "12 LPA": (14400.0, None, "12 LPA"), "₹15-25 LPA": (18000.0, 30000.0, "₹15-25 LPA"), "Rs 1.5 crore": (180000.0, None, "Rs 1.5 crore"), "INR 12,00,000": (14400.0, None, "INR 12,00,000"), "8L - 14L": (9600.0, 16800.0, "8L - 14L"),
        "Compensation: ₹20 LPA - ₹30 LPA based on": (24000.0, 36000.0, "₹20 LPA - ₹30 LPA"), "1 to 2 crore": (1200.0, 240000.0, "1 to 2 crore"), "5 LPA": (6000.0, None, "5 LPA"), "Rs 500": (None, None, None), "no pay": (None, None, None),
    }
    assert {k: salary.inr_salary(k) for k in pins} == pins
