"""Search quality: golden cases scored against ranked results, and reports over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words
from ..functions.urls import company_from_url

SENIOR = r"(?i)\b(senior|staff|principal|lead|director|vp|head of)\b"
GOLDEN_TYPE = (
    "name string, query string, expectations struct<topNMustMatch: struct<n: int, minScore: double, titleContainsAny: array<string>>, mustExcludeCompanies: array<string>, "
    "mustExcludeKeywordsInTitle: array<string>, topResultMinScore: double, noSeniorRoles: boolean>"
)


def score_cases(golden: DataFrame, ranked: DataFrame) -> DataFrame:
    """(name, score, passed, failures) of golden cases (GOLDEN_TYPE) against ranked rows (name, place, score, title, url).

    Five checks where a case has them: half of the top n, one at least, score enough and match a title pattern; the top
    score; no banned company; no banned title pattern; at most one senior title in the first five. The score is the share of checks
    that pass, 1 without any. A case without results is judged on none.
    """
    e = F.col("expectations")
    top, low_cos = e["topNMustMatch"], F.transform(e["mustExcludeCompanies"], lambda c: F.lower(c))
    title = F.coalesce("title", F.lit(""))
    matches = lambda patterns: F.exists(patterns, lambda p: F.regexp_like(title, F.concat(F.lit("(?i)"), p)))
    both = golden.select("name", "expectations").join(ranked, "name", "left")
    real = F.col("place").isNotNull()
    flags = both.select(
        "name", "expectations", "place", "score",
        (real & (F.col("place") <= top["n"]) & (F.col("score") >= top["minScore"]) & matches(top["titleContainsAny"])).alias("hit"), (real & F.array_contains(low_cos, F.lower(company_from_url(F.col("url"))))).alias("bad_company"),
        (real & matches(e["mustExcludeKeywordsInTitle"])).alias("bad_title"), (real & (F.col("place") <= 5) & title.rlike(ascii_words(SENIOR))).alias("senior"),
    )
    c = flags.groupBy("name").agg(
        F.first("expectations").alias("e"), F.count_if("hit").alias("hits"), F.count_if("bad_company").alias("companies"), F.count_if("bad_title").alias("titles"), F.count_if("senior").alias("seniors"), F.min_by("score", "place").alias("top_score"),
    )
    some = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    checks = {
        "topNMustMatch": (F.col("e.topNMustMatch").isNotNull(), F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("e.topNMustMatch.n") / 2))),
        "topResultMinScore": (F.col("e.topResultMinScore").isNotNull(), F.coalesce(F.col("top_score") >= F.col("e.topResultMinScore"), F.lit(False))),
        "mustExcludeCompanies": (some(F.col("e.mustExcludeCompanies")), F.col("companies") == 0),
        "mustExcludeKeywordsInTitle": (some(F.col("e.mustExcludeKeywordsInTitle")), F.col("titles") == 0),
        "noSeniorRoles": (F.coalesce(F.col("e.noSeniorRoles"), F.lit(False)), F.col("seniors") <= 1),
    }
    asked = sum((a.cast("int") for a, _ in checks.values()), F.lit(0))
    failures = F.array_compact(F.array(*[F.when(a & ~ok, F.lit(name)) for name, (a, ok) in checks.items()]))
    return c.withColumns({"asked": asked, "failures": failures}).select("name", F.when(F.col("asked") == 0, F.lit(1.0)).otherwise((F.col("asked") - F.size("failures")) / F.col("asked")).alias("score"), (F.size("failures") == 0).alias("passed"), "failures")


def eval_report(results: DataFrame, rubric_text: str) -> DataFrame:
    """One row over case results (score, passed, tokens, usd, ms), tagged with the hash of the rubric."""
    return results.agg(
        F.count("*").alias("cases"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("score").alias("avg_score"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"), F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"),
        F.sha2(F.lit(rubric_text), 256).alias("rubric"),
    )


def eval_candidates(local: DataFrame, frozen: DataFrame, least: int = 5) -> DataFrame:
    """Local candidates where a query has ``least`` or more, else local and frozen ones merged."""
    from .scoring import merge_candidates

    few = local.groupBy("query_id").count().filter(F.col("count") >= least).select("query_id")
    return merge_candidates(local, frozen.join(few, "query_id", "left_anti"))
