"""Checks of whole plans and streaming jobs on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import normalize_query
from ..plans.search import SearchInputs, batch_search, posting_id
from ..scratch import scratch_path
from ..streaming import jobs
from . import stores  # noqa: F401 - the batch twins of the streams are registered first
from .base import AS_OF_S, ORACLES, dims, duck, logical, now, query, read, seconds
from .corpus import _INDEX, _MATCHED, _PADDED, _RAW, _holds, _merged, _terms_of
from .enrich import _FIRST, _HOST, _duck_company


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return scratch_path(spark, "stream")


def _drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there and reads back what it appended."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


_ROUTE = ORACLES["parse_route"].replace(_RAW, "raw_query")
_EXTERNAL = "SELECT p.*, p.id % 40 AS query_id FROM postings p WHERE p.id % 40 IN (SELECT query_id FROM open_) AND p.id % 40 NOT IN (SELECT query_id FROM here GROUP BY 1 HAVING count(*) >= 5)"
_ROLE_AND_LEVEL = "coalesce(role, '') || ' ' || coalesce(seniority, '')"


# No query of the tables goes the route 'rule' (years and a city), and their places are the three of the logical table.
@query(f"""{duck("queries", "postings", "hidden_log")}, route AS ({_ROUTE}),
asked AS (SELECT query_id, raw_query, query_id % 150 AS owner, sha256(regexp_replace(trim(lower(raw_query)), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS raw_hash, raw_query AS role,
  CASE WHEN route = 'model' THEN location END AS location, CASE WHEN route = 'model' THEN remote END AS remote, CASE WHEN route = 'model' THEN seniority END AS seniority FROM queries JOIN route USING (query_id)),
held AS (SELECT a.raw_hash, p.*, row_number() OVER (PARTITION BY a.raw_hash ORDER BY p.id) - 1 AS pos, CASE p.id % 3 WHEN 0 THEN 0.5e0 ELSE p.id % 3 / 3.0e0 END AS score FROM asked a JOIN postings p ON p.id BETWEEN a.query_id AND a.query_id + 2 WHERE a.query_id % 10 = 0),
stored AS (SELECT q.query_id, q.owner, q.seniority, h.url, h.title, h.pos, h.score, true AS from_store FROM asked q JOIN held h USING (raw_hash)),
open_ AS (SELECT * FROM asked WHERE raw_hash NOT IN (SELECT raw_hash FROM held)), qt AS (SELECT query_id, unnest(list_distinct({_terms_of(_ROLE_AND_LEVEL)})) AS term FROM open_), {_INDEX}, {_MATCHED},
fit AS (SELECT ps.query_id, id, row_number() OVER (PARTITION BY ps.query_id ORDER BY pos) AS pos FROM ps JOIN postings p USING (id) JOIN open_ q USING (query_id) WHERE pos <= 2000 AND NOT (coalesce(remote, false) AND coalesce(NOT is_remote, false))
  AND (location IS NULL OR (location = 'Bangalore' AND location_raw IN ('Bengaluru, India', 'BLR')) OR (location = 'new york' AND trim(location_raw) = 'New   York'))),
here AS (SELECT * FROM fit WHERE pos <= 50), merged AS (WITH {_merged(_EXTERNAL, 'SELECT query_id, id, pos FROM here')}),
w AS (SELECT m.*, q.owner, q.seniority, count(*) OVER (PARTITION BY query_id, origin) AS n, list_distinct(list_filter(regexp_split_to_array(lower(raw_query), '[^a-z0-9]+'), lambda x: x <> '')) AS qw, regexp_split_to_array(lower(substr(title || ' ' || company, 1, 200)), '[^a-z0-9]+') AS tw FROM merged m JOIN open_ q USING (query_id)),
fresh AS (SELECT query_id, owner, seniority, url, title, pos, CASE WHEN n = 1 THEN 1.0e0 WHEN len(qw) = 0 THEN 0.0e0 ELSE floor(100.0e0 * len(list_filter(qw, lambda x: list_contains(tw, x))) / len(qw) + 0.5) / 100 END AS score, false AS from_store FROM w),
every AS (SELECT * FROM stored UNION ALL SELECT * FROM fresh), padded AS (SELECT *, {_PADDED} AS t, {_duck_company(_HOST, _FIRST)} AS of_url FROM every),
kept AS (SELECT * FROM padded e WHERE score >= 0.4 AND NOT EXISTS (SELECT 1 FROM hidden_log h WHERE h.owner = e.owner AND lower(trim(h.company)) = lower(e.of_url))
  AND NOT coalesce(CASE WHEN seniority = 'junior' THEN {_holds("t", dims.SENIOR_TOKENS)} WHEN seniority = 'senior' THEN {_holds("t", dims.JUNIOR_TOKENS)} END, false))
SELECT query_id, url, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INT) AS place, from_store FROM kept""")
def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole batch search over the logical tables, with a part of the queries in the store and other postings as external candidates."""
    p, q = logical(spark, sf_dir, "postings"), logical(spark, sf_dir, "queries")
    filters = F.struct(F.col("raw_query").alias("role"), "location", "remote", "seniority")
    queries = q.select("query_id", "raw_query", filters.alias("filters"), (F.col("query_id") % 150).alias("owner"))
    # every tenth query was asked before and has three postings in the store, one of them without a score
    asked = q.filter("query_id % 10 = 0").select("query_id", F.sha2(normalize_query(F.col("raw_query")), 256).alias("raw_hash"))
    near = asked.withColumn("n", F.explode(F.expr("sequence(query_id, query_id + 2)")))
    held = near.join(p.select(F.col("id").alias("n"), "url"), "n").withColumn("id", posting_id(F.col("url")))
    scores = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") % 3 != 0, F.struct("id", F.struct((F.col("n") % 3 / 3).alias("score"), F.lit("kept").alias("fit")))))))
    kept = held.groupBy("raw_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"), scores.alias("scores"))
    stored = kept.select(F.col("raw_hash").alias("query_hash"), "raw_hash", "ids", "scores", now().alias("created_at"))
    external = p.select((F.col("id") % 40).alias("query_id"), F.col("id").alias("pos"), "url", "title", "company", F.col("location_raw").alias("location"))
    hidden = logical(spark, sf_dir, "hidden_log").select("owner", F.lower(F.trim("company")).alias("company"))
    done = batch_search(SearchInputs(queries, p.drop("published_s", "last_seen_s"), stored, external, hidden), now())
    return done["results"].select("query_id", "url", "score", "place", "from_store")


@query(f"{duck('event_log')} SELECT CAST(floor(created_us / 3600000000) AS BIGINT) * 3600 AS hour_s, count(*) AS n FROM event_log GROUP BY 1 HAVING hour_s + 3600 <= (SELECT floor(max(created_us) / 1000000) - 600 FROM event_log)")
def stream_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed, from the event stream."""
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    folder = _folder(spark)
    events.write.parquet(f"{folder}/in")
    volume = jobs.stream_volume(jobs.event_stream(spark, f"{folder}/in"))
    return _drain(volume, folder).select(seconds(F.col("hour")).alias("hour_s"), "n")


@query(f"SELECT 'https://x.example/' || p_partkey AS url, p_name AS title, {AS_OF_S}::BIGINT AS last_seen_s FROM part")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed payloads made from parts, landed as files, merged by the stream."""
    from ..sources import feeds
    from . import sources

    parts = sources._parts(spark, sf_dir)
    job = F.struct(F.col("k").alias("id"), F.col("name").alias("title"), F.col("link").alias("absolute_url"), F.col("html").alias("content"))
    folder = _folder(spark)
    payloads = sources._payloads(parts, job, lambda x: F.struct(x.alias("jobs")))
    payloads.select("body").repartition(25).write.option("maxRecordsPerFile", 1).text(f"{folder}/in")
    jobs.stream_feeds(spark, f"{folder}/in", feeds.read_greenhouse, f"{folder}/state", f"{folder}/log", now())
    return jobs.feed_state(spark, f"{folder}/state").select("url", "title", seconds(F.col("last_seen_at")).alias("last_seen_s"))


def _requests_through(spark: SparkSession, sf_dir: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stateful job over the requests as a stream."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = _folder(spark)
        logical(spark, sf_dir, "requests").select("key", "event_id", "ts_us").write.parquet(f"{folder}/in")
        stream = spark.readStream.schema("key bigint, event_id bigint, ts_us bigint").parquet(f"{folder}/in")
        return _drain(job(stream), folder)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@query(ORACLES["token_bucket"])
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests_through(spark, sf_dir, lambda requests: jobs.stream_token_bucket(requests, 2, 36_000))


@query(ORACLES["sliding_window"])
def stream_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests_through(spark, sf_dir, lambda requests: jobs.stream_sliding_window(requests, 2, 36_000)).select("event_id", "n", "allowed")


@query(ORACLES["fixed_window"])
def stream_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests_through(spark, sf_dir, lambda requests: jobs.stream_fixed_window(requests, 3)).select("event_id", "allowed")


@query(f"{duck('queries', 'postings')} SELECT q.query_id, p.id FROM queries q JOIN postings p ON p.id % 40 = q.query_id")
def snapshot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate lists frozen by query key and read back for the queries that have one."""
    from ..sources import feeds

    q = logical(spark, sf_dir, "queries").select("query_id", "raw_query")
    candidates = logical(spark, sf_dir, "postings").select((F.col("id") % 40).alias("query_id"), "id").join(q, "query_id")
    folder = _folder(spark)
    feeds.snapshot_candidates(candidates, folder)
    return feeds.read_snapshot(spark, folder, candidates.select("raw_query").distinct()).select("query_id", "id")
