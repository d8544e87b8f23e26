"""Logical tables derived from the driver's tables, written once in SQL that both engines read.

The text uses three marks that differ by engine: {T:name} a table, EPOCH_US(x) microseconds of a timestamp and
JSON_K(x) the number under $.k. Times are seconds (``*_s``) here; ``logical`` adds real timestamps under ``*_at``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed clock of all checks: 2024-01-15 12:00:00 UTC.
AS_OF_S = 1705320000
AS_OF = "2024-01-15 12:00:00"
#: The clock for tables made from orders: 2001-07-02.
ORDERS_AS_OF_S = 994032000

TABLES = {
    "postings": """
SELECT doc_id AS id,
  CASE doc_id % 10 WHEN 0 THEN 'https://boards.greenhouse.io' WHEN 1 THEN 'https://jobs.lever.co' WHEN 2 THEN 'https://jobs.ashbyhq.com' WHEN 3 THEN 'https://apply.workable.com'
    WHEN 4 THEN 'https://jobs.smartrecruiters.com' WHEN 5 THEN 'https://' || source || '.myworkdayjobs.com' WHEN 6 THEN 'https://' || source || '.bamboohr.com'
    WHEN 7 THEN 'https://' || source || '.recruitee.com' WHEN 8 THEN 'https://' || source || '.teamtailor.com' ELSE 'https://' || source || '.jobs.personio.de' END
  || CASE WHEN doc_id % 7 = 0 THEN '/en-us' ELSE '' END
  || CASE doc_id % 10 WHEN 0 THEN '/' || source || '/jobs/' WHEN 1 THEN '/' || source || '/abcdef' WHEN 2 THEN '/' || source || '/role-' WHEN 3 THEN '/' || source || '/j/' WHEN 4 THEN '/' || source || '/'
    WHEN 5 THEN '/board/job/' WHEN 6 THEN '/careers/' WHEN 7 THEN '/o/' WHEN 8 THEN '/jobs/' ELSE '/job/' END
  || CAST(100 + doc_id AS STRING) || CASE WHEN doc_id % 11 = 0 THEN '/blog/post' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '/' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN '?src=x#apply' ELSE '' END AS url,
  CASE doc_id % 8 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Junior Developer' WHEN 2 THEN 'Staff Platform Engineer, Infra' WHEN 3 THEN 'Data Analyst' WHEN 4 THEN 'Jane Roe | SmartRecruiters'
    WHEN 5 THEN 'Growth tips - Author at Lever' WHEN 6 THEN 'Lead Designer' ELSE 'Marketing Intern' END AS title,
  source AS company, text AS description,
  CASE doc_id % 9 WHEN 1 THEN 'Bengaluru, India' WHEN 2 THEN 'BLR' WHEN 3 THEN 'SF' WHEN 4 THEN '  New   York ' WHEN 5 THEN 'Remote EU' WHEN 6 THEN 'Gurgaon, HR' WHEN 7 THEN 'Washington, DC' WHEN 8 THEN 'london' END AS location_raw,
  CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_remote,
  CASE WHEN doc_id % 10 <> 0 THEN 1704067200 + doc_id * 3600 END AS published_s,
  CASE WHEN doc_id % 10 <> 0 THEN 1704067200 + doc_id * 3600 + (doc_id % 40) * 86400 END AS last_seen_s
FROM {T:documents}""",
    "salary_text": """
SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'Pay is competitive.' WHEN doc_id % 5 = 1 THEN 'Pay EUR; €' || CAST(40 + doc_id % 60 AS STRING) || ',000 a year'
  ELSE 'Pay $' || CAST(50 + doc_id % 150 AS STRING) || 'k - $' || CAST(60 + doc_id % 150 AS STRING) || 'k per year' END AS text FROM {T:documents}""",
    "queries": """
SELECT item_id AS query_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4) AS raw_query,
  CASE WHEN item_id % 2 = 0 THEN true END AS remote, CASE item_id % 4 WHEN 1 THEN 'Bangalore' WHEN 2 THEN 'new york' WHEN 3 THEN 'Remote, EU' END AS location,
  CASE item_id % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'junior' END AS seniority FROM {T:benchmark}""",
    "scores": """
SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN 1.7e0 ELSE (2 * quality + (1 - toxic)) / 3.0e0 END AS score FROM {T:labels}""",
    "event_log": """
SELECT event_id, EPOCH_US(ts) AS created_us, user_id, event_type,
  CASE event_type WHEN 'purchase' THEN 'digest_email_sent' WHEN 'signup' THEN 'saved_search_run_completed' ELSE 'search' END AS evt,
  event_type = 'click' AS cache_hit, event_type = 'error' AS rerank_failed, CAST(floor(value * 100) AS BIGINT) AS total_ms, JSON_K(props) AS parse_ms,
  CASE WHEN event_type <> 'click' THEN 40 * JSON_K(props) END AS tokens, CASE WHEN event_type <> 'click' THEN 0.005e0 ELSE 0.0e0 END AS search_usd FROM {T:events}""",
    "requests": "SELECT event_id, user_id AS key, EPOCH_US(ts) AS ts_us FROM {T:events}",
    "interaction_log": """
SELECT event_id, user_id AS owner, JSON_K(props) AS job_id, EPOCH_US(ts) AS ts_us,
  CASE event_type WHEN 'view' THEN 'saved' WHEN 'click' THEN 'applied' WHEN 'purchase' THEN 'dismissed' WHEN 'signup' THEN 'hidden' ELSE 'saved' END AS kind, event_type = 'error' AS is_delete FROM {T:events}""",
    "hidden_log": "SELECT event_id, user_id AS owner, ' SRC' || CAST(JSON_K(props) % 20 AS STRING) || ' ' AS company, EPOCH_US(ts) AS ts_us, JSON_K(props) % 7 = 0 AS is_delete FROM {T:events} WHERE event_type = 'error'",
    "feedback": """
SELECT event_id, user_id AS owner, EPOCH_US(ts) AS ts_us, CASE event_type WHEN 'view' THEN 'relevance' WHEN 'click' THEN 'bug' WHEN 'purchase' THEN 'idea' WHEN 'signup' THEN 'praise' ELSE 'spam' END AS kind,
  CASE WHEN JSON_K(props) % 9 = 0 THEN NULL ELSE repeat('comment ', CAST(JSON_K(props) AS INT)) END AS comment FROM {T:events}""",
    "users": "SELECT c_custkey AS id, c_name || '@mail.example' AS email, CASE WHEN c_custkey % 2 = 0 THEN 'anon-' || CAST(c_custkey AS STRING) END AS anon_id FROM {T:customer} WHERE c_custkey % 3 <> 0",
    "saved_searches": f"""
SELECT c_custkey AS search_id, CASE WHEN c_custkey % 2 = 0 THEN 'anon-' || CAST(c_custkey % 100 AS STRING) END AS anon_id, CASE WHEN c_custkey % 2 = 1 THEN c_custkey END AS user_id,
  'q' || CAST(c_custkey % 40 AS STRING) AS query_hash, CASE c_custkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'daily' ELSE 'weekly' END AS cadence,
  CASE WHEN c_custkey % 10 <> 0 THEN {AS_OF_S} - (c_custkey % 10) * 86400 END AS last_run_s, CASE WHEN c_custkey % 4 <> 0 THEN {AS_OF_S} - (c_custkey % 9) * 86400 END AS last_notified_s,
  CASE WHEN c_custkey % 5 = 0 THEN 'notify' || CAST(c_custkey AS STRING) || '@mail.example' END AS notify_email, {AS_OF_S} - c_custkey * 3600 AS created_s FROM {{T:customer}}""",
    "run_ids": """
SELECT o_orderkey AS run_id, o_custkey AS search_id, EPOCH_US(o_orderdate) / 1000000 AS created_s, l_partkey AS posting_id, l_linenumber AS line FROM {T:orders} JOIN {T:lineitem} ON o_orderkey = l_orderkey""",
    "store_postings": "SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS company, 'https://jobs.lever.co/' || p_type || '/' || CAST(p_partkey AS STRING) AS url, p_type || ' ' || p_name || ' role' AS description FROM {T:part} WHERE p_partkey % 7 <> 0",
    "tenants": f"""
SELECT CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'smartrecruiters' END AS ats,
  CASE WHEN s_suppkey % 25 = 1 THEN 'LeverDemo' ELSE 's' || CAST(s_suppkey AS STRING) END AS slug, CASE (s_suppkey - s_suppkey % 4) % 16 WHEN 0 THEN 'candidate' WHEN 4 THEN 'verified' WHEN 8 THEN 'rate_limited' ELSE 'dead' END AS status,
  CASE WHEN s_suppkey % 8 <> 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS jobs_last_seen, s_nationkey % 5 = 0 AS flagged, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS company_name,
  {AS_OF_S} - s_suppkey * 60 AS discovered_s, CASE WHEN s_suppkey % 6 <> 0 THEN {AS_OF_S} - s_suppkey * 30 END AS verified_s, CASE WHEN s_suppkey % 5 = 0 THEN 'old' END AS notes, 'seed' AS source FROM {{T:supplier}}""",
    "eval_runs": """
SELECT (doc_id - doc_id % 100) / 100 AS run_id, doc_id AS case_id, CAST(quality AS DOUBLE) AS score, toxic = 0 AS passed, 'r' || CAST(((doc_id - doc_id % 100) / 100) % 3 AS STRING) AS rubric, 1704067200 + doc_id * 60 AS created_s FROM {T:labels}""",
}
_MARK = re.compile(r"\{T:(\w+)\}")


def _whole(sql: str) -> str:
    """Divisions that are exact by construction give whole numbers in both engines."""
    return sql.replace("EPOCH_US(o_orderdate) / 1000000", "CAST(floor(EPOCH_US(o_orderdate) / 1000000) AS BIGINT)").replace("(doc_id - doc_id % 100) / 100", "CAST(floor((doc_id - doc_id % 100) / 100) AS BIGINT)")


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table over the driver's tables in ``sf_dir``."""
    sql = _whole(TABLES[name]).replace("EPOCH_US(", "unix_micros(").replace("JSON_K(props)", "CAST(get_json_object(props, '$.k') AS BIGINT)")
    tables = {}
    for t in set(_MARK.findall(sql)):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        tables[t] = df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})
    df = spark.sql(_MARK.sub(r"{\1}", sql), **tables)
    return df.withColumns({c[:-2] + "_at": F.timestamp_seconds(c) for c in df.columns if c.endswith("_s")} | {c[:-3] + "_at": F.timestamp_micros(c) for c in df.columns if c.endswith("_us") and c != "ts_us"})


def duck(*names: str) -> str:
    """The same tables as the head of a DuckDB statement; continue with a comma or SELECT."""
    parts = [f"{n} AS ({_MARK.sub(r'\1', _whole(TABLES[n])).replace('EPOCH_US(', 'epoch_us(').replace('JSON_K(props)', "CAST(json_extract_string(props, '$.k') AS BIGINT)")})" for n in names]
    return "WITH " + ", ".join(parts)
