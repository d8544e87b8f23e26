"""Scores of candidates: in batches by a pluggable scorer, validated, cut, and costed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from .merge import content_key, greedy_dedupe

#: Scores and fits of texts for a query, in their order; None if the scorer rated nothing. What it raises fails the query.
Scorer = Callable[[str, list[str]], list[tuple[float, str]] | None]
RAW_SCORES = "query_id long, pos int, score double, fit string, batch_failed boolean, failed boolean"


def lexical_scores(query: Column, text: Column) -> tuple[Column, Column]:
    """Share of the query's words that a text holds, to two places, and a fit that names how many."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    n, held = F.size(words(query)), F.size(F.array_intersect(words(query), words(text)))
    return F.when(n > 0, F.floor(100 * held / n + 0.5) / 100).otherwise(F.lit(0.0)).cast("double"), F.concat(held.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" words"))


def score_batches(candidates: DataFrame, scorer: Scorer | None = None, size: int = dims.SCORE_BATCH) -> DataFrame:
    """(query_id, pos, score, fit, batch_failed, failed) of candidates (query_id, pos, raw_query, text), scored in batches of ``size``
    of one query on the first 200 characters of each; without a scorer, by words.

    A batch that the scorer leaves unrated is marked batch_failed, and every candidate of a query of which a batch raised is
    failed; both have no score. Queries are dealt out whole and their batches scored one after another as rows arrive.
    """
    rows = candidates.select("query_id", "pos", "raw_query", F.substring(F.coalesce("text", F.lit("")), 1, dims.SCORE_TEXT_CHARS).alias("text"))
    if scorer is None:
        score, fit = lexical_scores(F.col("raw_query"), F.col("text"))
        return rows.select("query_id", "pos", score.alias("score"), fit.alias("fit"), F.lit(False).alias("batch_failed"), F.lit(False).alias("failed"))

    def rate(query: str | None, texts: list[str]) -> tuple[list[tuple[float | None, str | None]], bool, bool]:
        try:
            scored = scorer(query or "", texts)
        except Exception:
            return [(None, None)] * len(texts), False, True
        return (scored, False, False) if scored is not None else ([(None, None)] * len(texts), True, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrived = ((q, int(p), raw, t) for b in batches for q, p, raw, t in zip(b["query_id"], b["pos"], b["raw_query"], b["text"], strict=True))
        for (q, _), g in groupby(arrived, key=lambda r: (r[0], r[1] // size)):
            own = list(g)
            scored, unrated, failed = rate(own[0][2], [r[3] for r in own])
            out = [(q, r[1], s, f, unrated, failed) for r, (s, f) in zip(own, scored, strict=True)]
            yield pd.DataFrame(out, columns=["query_id", "pos", "score", "fit", "batch_failed", "failed"])

    raw = rows.repartition("query_id").sortWithinPartitions("query_id", "pos").mapInPandas(run, RAW_SCORES)
    lost = raw.withColumn("failed", F.max("failed").over(Window.partitionBy("query_id")))
    return lost.withColumns({"score": F.when(~F.col("failed"), F.col("score")), "fit": F.when(~F.col("failed"), F.col("fit"))})


def validate_scores(candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """(query_id, pos, score, fit): candidates (query_id, pos, batch_failed) with their raw scores (query_id, pos, score,
    fit). Scores of unknown positions and unscored candidates go; scores outside 0..1 and missing numbers are 0.5;
    fits are cut to 80; a query's only candidate is 1.0; candidates of a failed batch are 0.5."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    own = candidates.select("query_id", "pos", F.coalesce("batch_failed", F.lit(False)).alias("batch_failed")).withColumn("n", n)
    got = raw.select("query_id", "pos", F.col("score").alias("raw_score"), "fit", F.lit(True).alias("scored"))
    both = own.join(got, ["query_id", "pos"], "left").filter("scored or batch_failed or n = 1")
    sound = F.when(F.col("raw_score").between(0, 1), F.col("raw_score")).otherwise(F.lit(0.5))
    score = F.when(F.col("n") == 1, F.lit(1.0)).when(F.col("batch_failed"), F.lit(0.5)).otherwise(sound)
    fit = F.when(F.col("n") == 1, F.coalesce("fit", F.lit(""))).when(F.col("batch_failed"), F.lit("Relevance not rated")).otherwise(F.substring(F.coalesce("fit", F.lit("")), 1, 80))
    return both.select("query_id", "pos", score.alias("score"), fit.alias("fit"))


def apply_min_score(scored: DataFrame, least: float = dims.MIN_SCORE) -> DataFrame:
    """Rows (failed, score) that reach ``least``, a missing score being 0.5; all rows of a failed query stay with 0.5, are
    not filtered further and not stored."""
    failed = F.coalesce("failed", F.lit(False))
    kept = scored.withColumn("score", F.when(failed, F.lit(0.5)).otherwise(F.coalesce("score", F.lit(0.5)))).filter(failed | (F.col("score") >= least))
    return kept.withColumns({"filter_further": ~failed, "store": ~failed})


def merge_candidates(local: DataFrame, external: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Candidates (query_id, pos, url, title, company, location, and the ``more`` columns): the local ones first, then the external
    ones that pass the quality filter, copies dropped, positions renumbered from 0. What a side lacks of the ``more`` is null."""
    from ..functions.urls import canonical_url
    from .retrieval import quality_keep

    def side(df: DataFrame, origin: int) -> DataFrame:
        return df.select("query_id", "url", "title", "company", "location", *[c for c in more if c in df.columns], F.lit(origin).alias("origin"), F.col("pos").alias("own_pos"))

    every = side(local, 0).unionByName(side(quality_keep(external), 1), allowMissingColumns=True)
    w = Window.partitionBy("query_id").orderBy("origin", "own_pos")
    placed = every.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumns({"url_key": canonical_url(F.col("url")), "content_key": content_key(F.col("company"), F.col("title"), F.col("location"))})
    kept = greedy_dedupe(placed)
    return kept.withColumn("pos", (F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1).cast("int")).drop("url_key", "content_key", "own_pos")


def llm_cost(parse_tokens: Column, rank_tokens: Column) -> Column:
    """Dollars to six places; null without tokens."""
    total = F.coalesce(parse_tokens, F.lit(0)) + F.coalesce(rank_tokens, F.lit(0))
    return F.when(total != 0, F.floor(total / 1000 * dims.LLM_USD_PER_1K * 1e6 + 0.5) / 1e6)


def synthetic_scores(candidates: DataFrame) -> DataFrame:
    """The first half of each query's candidates 0.8, the rest 0.4."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return candidates.withColumn("score", F.when(F.col("pos") < n / 2, F.lit(0.8)).otherwise(F.lit(0.4)))
