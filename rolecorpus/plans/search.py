"""The batch search: a table of queries answered from the corpus, with external candidates where it falls short."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import geo
from ..operators import retrieval as r
from ..operators import scoring as s
from ..operators import store
from ..operators.index import TermIndex
from ..scratch import settle


@dataclass
class SearchInputs:
    """queries(query_id, raw_query, filters struct or null, owner), postings, result_store (query_hash, raw_hash, ids, scores, created_at),
    external candidates, hidden companies; with a kept ``index`` of the postings' ids no posting's words are read."""

    queries: DataFrame
    postings: DataFrame
    result_store: DataFrame
    external: DataFrame
    hidden: DataFrame
    index: TermIndex | None = None


def parse_queries(queries: DataFrame) -> DataFrame:
    """Queries with a route and filters: by rule, the plain title, or for 'model' those that came with the query (by rule
    where none came)."""
    route = r.parse_route(F.col("raw_query"))
    ruled = r.rule_parse(F.col("raw_query"))
    given = F.col("filters")
    pick = lambda f: F.when(F.col("route") == "rule", F.col(f"ruled.{f}")).when(F.col("route") == "fast", F.col("raw_query") if f == "role" else F.lit(None)).otherwise(F.when(given.isNotNull(), given[f]).otherwise(F.col(f"ruled.{f}")))
    parsed = queries.withColumns({"route": route, "ruled": ruled})
    return parsed.select(*queries.columns, "route", pick("role").alias("role"), pick("location").alias("location"), pick("remote").alias("remote"), F.when(F.col("route") == "model", given["seniority"]).alias("seniority")).drop("filters")


#: What results carry of their postings besides url, title, company and place.
CARRIED = ("published_at", "salary_min_usd", "salary_max_usd", "salary_raw")


def posting_id(url: Column) -> Column:
    return F.sha2(url, 256)


def answered(open_queries: DataFrame, stored: DataFrame, inputs: SearchInputs, newest: bool, fresh_only: bool, as_of: Column) -> DataFrame:
    """The rows of queries (query_id, raw_hash, seniority, owner) that the store answers (query_hash, raw_hash, ids, scores): postings in
    the stored order with their stored scores, 0.5 where there is none, cut, and filtered as fresh results are."""
    postings = inputs.postings.withColumn("id", posting_id(F.col("url"))).withColumnRenamed("location_raw", "location")
    found = store.hydrate(stored.select("query_hash", "ids"), postings)
    scored = found.join(stored.select("query_hash", "raw_hash", "scores"), "query_hash").withColumn("got", F.try_element_at("scores", F.col("id")))
    rows = scored.select("raw_hash", (F.col("place") - 1).alias("pos"), "url", "title", "company", "location", *[c for c in CARRIED if c in scored.columns], F.coalesce("got.score", F.lit(0.5)).alias("score"), F.coalesce("got.fit", F.lit("")).alias("fit"))
    asked = open_queries.select("query_id", "raw_hash", "seniority", "owner").join(rows, "raw_hash")
    kept = s.apply_min_score(asked.withColumn("failed", F.lit(False)))
    return r.order_results(r.seniority_filter(r.hide_companies(kept, inputs.hidden)), newest, fresh_only, as_of)


def batch_search(inputs: SearchInputs, as_of: Column, k: int = dims.TOP_K, scorer: s.Scorer | None = None, newest: bool = False, fresh_only: bool = False) -> dict[str, DataFrame]:
    """hits: queries answered by the store; results: ranked rows of all queries, ``from_store`` or fresh; store: results to merge
    into it.

    One join by (term, posting) for the division, one shuffle by query for the ranking; everything after works on at most
    ``widened(k)`` rows a query. Salaries that a posting lacks are read from its description. Local candidates are scored in one pass,
    external ones that are new in a second, so the only candidate of a pass is 1.0. If the scorer fails a pass, all the query's
    candidates stay with 0.5, are not filtered further and not stored.
    """
    postings = inputs.postings
    for c, kind in (("salary_min_usd", "double"), ("salary_max_usd", "double"), ("salary_raw", "string")):
        if c not in postings.columns:
            postings = postings.withColumn(c, F.lit(None).cast(kind))
    inputs = replace(inputs, postings=postings)
    keyed = inputs.queries.withColumn("raw_hash", F.sha2(r.normalize_query(F.col("raw_query")), 256))
    live = store.lookup_by_raw(keyed, inputs.result_store, as_of)
    # a stored result without a posting that is still there answers nothing
    stored = inputs.result_store.join(live, ["raw_hash", "query_hash"], "left_semi")
    present = stored.select("query_hash", F.explode("ids").alias("id")).join(postings.select(posting_id(F.col("url")).alias("id")), "id", "left_semi").select("query_hash").distinct()
    hits = settle(live.join(present, "query_hash", "left_semi"), "search-hits")
    parsed = geo.location_terms(parse_queries(keyed))
    open_ = settle(parsed.join(hits.select("raw_hash"), "raw_hash", "left_anti"), "search-open")
    ready = answered(parsed.join(hits.select("raw_hash"), "raw_hash", "left_semi"), stored.join(hits.select("query_hash"), "query_hash", "left_semi"), inputs, newest, fresh_only, as_of)
    terms = r.query_terms(open_, ["role", "seniority"])
    if inputs.index is not None:
        ranked = inputs.index.top(terms, postings, r.widened(k))
    else:
        ranked = r.rank_topk(settle(r.match_all_terms(terms, postings), "search-matches"), postings, r.widened(k))
    wide = ranked.join(postings, "id").join(open_.select("query_id", "raw_query", "remote", "seniority", "loc_terms", "owner"), "query_id")
    local = settle(r.backfill_salary(r.location_postfilter(r.remote_postfilter(wide), k)), "search-local")
    few = r.needs_fallback(open_, local).filter("fallback").select("query_id")
    ours = local.select("query_id", "pos", "url", "title", "company", F.col("location_raw").alias("location"), *CARRIED)
    merged = s.merge_candidates(ours, inputs.external.join(few, "query_id", "left_semi"), CARRIED)
    # local and external candidates are scored in passes of their own, each as the scorer's whole query: what the first pass gave stands
    turn = Window.partitionBy("query_id", "origin").orderBy("pos")
    passes = merged.withColumns({"pass_id": (F.col("query_id") * 2 + F.col("origin")).cast("long"), "pass_pos": F.row_number().over(turn) - 1})
    asked = settle(passes.join(open_.select("query_id", "raw_query", "seniority", "owner", "raw_hash"), "query_id"), "search-asked")
    seen = asked.select(F.col("pass_id").alias("query_id"), F.col("pass_pos").alias("pos"), "raw_query", F.concat_ws(" ", "title", "company").alias("text"))
    raw = settle(s.score_batches(seen, scorer), "search-scores")
    marked = seen.select("query_id", "pos").join(raw.select("query_id", "pos", "batch_failed", "failed"), ["query_id", "pos"], "left")
    rated = s.validate_scores(marked, raw.filter("not batch_failed and not failed").select("query_id", "pos", "score", "fit"))
    both = marked.join(rated, ["query_id", "pos"], "left").select(F.col("query_id").alias("pass_id"), F.col("pos").alias("pass_pos"), "score", "fit", "failed")
    ended = asked.join(both, ["pass_id", "pass_pos"]).withColumn("failed", F.max(F.coalesce("failed", F.lit(False))).over(Window.partitionBy("query_id")))
    scored = ended.filter("failed or score is not null")
    kept = s.apply_min_score(scored.withColumns({"fit": F.when(F.col("failed"), F.lit("")).otherwise(F.col("fit"))}))
    filtered = r.seniority_filter(r.hide_companies(kept.filter("filter_further"), inputs.hidden))
    fresh = r.order_results(filtered.unionByName(kept.filter("not filter_further")), newest, fresh_only, as_of)
    columns = ["query_id", "raw_hash", "url", "title", "company", "location", *CARRIED, "score", "fit", "place", "page"]
    results = fresh.select(*columns, F.lit(False).alias("from_store")).unionByName(ready.select(*columns, F.lit(True).alias("from_store")))
    batch = fresh.filter("store").select(F.sha2(F.concat_ws("|", "raw_hash", F.coalesce("seniority", F.lit(""))), 256).alias("query_hash"), "raw_hash", F.col("place").alias("pos"), posting_id(F.col("url")).alias("id"), "score", "fit")
    return {"hits": hits, "results": results, "store": batch}
