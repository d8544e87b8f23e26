"""The store of results: look-ups within their time, hydration in order, upserts, pages and purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..scratch import settle
from .merge import merge


def since(as_of: Column, hours: int) -> Column:
    return as_of - F.make_dt_interval(hours=F.lit(hours))


def lookup_by_hash(queries: DataFrame, store: DataFrame, as_of: Column, ttl_hours: int = dims.STORE_TTL_HOURS) -> DataFrame:
    """Stored results (query_hash, ids, ...) of the queries that are no older than the time to live."""
    return queries.select("query_hash").distinct().join(store.filter(F.col("created_at") >= since(as_of, ttl_hours)), "query_hash")


def lookup_by_raw(queries: DataFrame, store: DataFrame, as_of: Column, ttl_hours: int = dims.STORE_TTL_HOURS) -> DataFrame:
    """The newest unexpired result of each raw hash."""
    live = store.filter(F.col("created_at") >= since(as_of, ttl_hours))
    newest = live.groupBy("raw_hash").agg(F.max_by("query_hash", F.struct("created_at", "query_hash")).alias("query_hash"))
    return queries.select("raw_hash").distinct().join(newest, "raw_hash")


def hydrate(results: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_hash, place, posting columns): stored ids in their order, missing postings left out, places renumbered. If the results hold
    ``scores`` by id, each row has its score too, null where there is none.

    The results (one row per query_hash) are written once with a number each, and that number goes through the shuffles by id and by
    result in place of the hash.
    """
    kept = settle(results.select("query_hash", "ids", *[c for c in results.columns if c == "scores"]).withColumn("result_no", F.monotonically_increasing_id()), "store-results")
    rows = kept.select("result_no", *[c for c in kept.columns if c == "scores"], F.posexplode("ids").alias("pos", "id"))
    if "scores" in rows.columns:
        rows = rows.withColumn("score", F.try_element_at("scores", F.col("id"))["score"]).drop("scores")
    w = Window.partitionBy("result_no").orderBy("pos")
    placed = rows.join(postings, "id").withColumn("place", F.row_number().over(w)).drop("pos")
    return placed.join(kept.select("result_no", "query_hash"), "result_no").drop("result_no")


def ranked_results(results: DataFrame) -> DataFrame:
    """(query_hash, raw_hash, ids, scores) of ranked results (query_hash, raw_hash, pos, id, score, fit): ids in order, scores by id."""
    rows = results.groupBy("query_hash").agg(F.first("raw_hash").alias("raw_hash"), F.collect_list(F.struct("pos", "id", "score", "fit")).alias("rows"))
    by_id = F.transform("rows", lambda x: F.struct(x["id"].alias("id"), F.struct(x["score"].alias("score"), x["fit"].alias("fit"))))
    return rows.select("query_hash", "raw_hash", F.transform(F.array_sort("rows"), lambda x: x["id"]).alias("ids"), F.map_from_entries(F.array_distinct(by_id)).alias("scores"))


def store_results(store: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """The store with ranked results merged by query hash, their time renewed."""
    return merge(store, ranked_results(results).withColumn("created_at", as_of), ["query_hash"], {})


def result_page(hydrated: DataFrame, least: float = dims.MIN_SCORE) -> DataFrame:
    """Rows in stored order with no score or one that reaches ``least``, and a snippet of 300 characters."""
    return hydrated.filter(F.col("score").isNull() | (F.col("score") >= least)).withColumn("snippet", F.substring("description", 1, 300))


def purge(tables: dict[str, DataFrame], users: DataFrame, as_of: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is kept of result_store, transfer_codes, saved_searches, interactions and hidden, and one row of how many each loses.

    Results go after 7 days, codes when they expire, anonymous searches after 30 days, and actions after 30 days if their
    owner has a dash in it and is no user.
    """
    old = lambda at, days: at < as_of - F.make_dt_interval(days=F.lit(days))
    known = users.select(F.col("id").cast("string").alias("purge_owner")).distinct()

    def orphans(df: DataFrame) -> DataFrame:
        marked = df.withColumn("purge_owner", F.col("owner").cast("string")).join(known.withColumn("purge_known", F.lit(True)), "purge_owner", "left")
        gone = old(F.col("created_at"), dims.ANON_RETENTION_DAYS) & F.contains("purge_owner", F.lit("-")) & F.col("purge_known").isNull()
        return marked.withColumn("purge_gone", gone).drop("purge_owner", "purge_known")

    rules = {
        "result_store": lambda df: df.withColumn("purge_gone", old(F.col("created_at"), dims.STORE_PURGE_DAYS)),
        "transfer_codes": lambda df: df.withColumn("purge_gone", F.col("expires_at") < as_of),
        "saved_searches": lambda df: df.withColumn("purge_gone", F.col("anon_id").isNotNull() & F.col("user_id").isNull() & old(F.col("created_at"), dims.ANON_RETENTION_DAYS)),
        "interactions": orphans, "hidden": orphans,
    }
    kept, counts = {}, None
    for name, df in tables.items():
        marked = rules[name](df)
        kept[name] = marked.filter(~F.coalesce("purge_gone", F.lit(False))).drop("purge_gone")
        n = marked.agg(F.lit(name).alias("table"), F.count_if("purge_gone").alias("purged"))
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts
