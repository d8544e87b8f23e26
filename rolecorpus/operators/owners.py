"""Owner actions: replayed logs, saved postings, hidden companies, feedback and merged identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims

FEEDBACK_KINDS = ["relevance", "bug", "idea", "praise"]


def newest_events(log: DataFrame, key: list[str]) -> DataFrame:
    """(key, event_id, ts_us, is_delete): the newest event of each key. It can be taken again over what it gave and further events."""
    newest = log.groupBy(*key).agg(F.max_by(F.struct("event_id", "ts_us", "is_delete"), F.struct("ts_us", "event_id")).alias("e"))
    return newest.select(*key, "e.*")


def live(newest: DataFrame) -> DataFrame:
    return newest.filter("not is_delete").drop("is_delete")


def replay(log: DataFrame, key: list[str]) -> DataFrame:
    """The state that a log of set and unset events (ts_us, event_id, is_delete) leaves: the newest of each key, unless it unset."""
    return live(newest_events(log, key))


INTERACTION_KEY, HIDDEN_KEY = ["owner", "job_id", "kind"], ["owner", "company"]


def interaction_events(log: DataFrame) -> DataFrame:
    return log.filter(F.col("kind").isin(dims.INTERACTION_KINDS))


def hidden_events(log: DataFrame) -> DataFrame:
    return log.withColumn("company", F.lower(F.trim("company"))).filter("company != ''")


def apply_actions(log: DataFrame) -> DataFrame:
    return replay(interaction_events(log), INTERACTION_KEY)


def saved_jobs(interactions: DataFrame, postings: DataFrame, most: int = 100) -> DataFrame:
    """Each owner's newest saved postings; hidden companies are not left out here."""
    w = Window.partitionBy("owner").orderBy(F.desc("ts_us"), F.desc("event_id"))
    rows = interactions.filter("kind = 'saved'").join(postings.select(F.col("id").alias("job_id"), "title", "url"), "job_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def hidden_state(log: DataFrame) -> DataFrame:
    return replay(hidden_events(log), HIDDEN_KEY)


def merge_identity(table: DataFrame, mapping: DataFrame, unique_key: list[str], newest: str) -> DataFrame:
    """A table (owner, ...) with anonymous owners (anon_id) renamed to users (user_id), one row per unique key: the newest."""
    named = table.join(mapping.select(F.col("anon_id").alias("owner"), F.col("user_id").alias("as_user")), "owner", "left").withColumn("owner", F.coalesce("as_user", "owner")).drop("as_user")
    w = Window.partitionBy(*unique_key).orderBy(F.desc(newest), *[c for c in named.columns if c not in (*unique_key, newest)])
    return named.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def feedback_intake(events: DataFrame, most: int = 100) -> DataFrame:
    """The newest ``most`` feedback events of a known kind with a comment, cut to 500 characters."""
    fine = events.filter(F.col("kind").isin(FEEDBACK_KINDS) & F.col("comment").isNotNull() & F.col("owner").isNotNull())
    return fine.withColumn("comment", F.substring("comment", 1, 500)).orderBy(F.desc("ts_us"), F.desc("event_id")).limit(most)


def sitemap_rows(postings: DataFrame, most: int = 1000) -> DataFrame:
    return postings.orderBy(F.desc_nulls_last("last_seen_at"), "id").limit(most).select("id", "url", "last_seen_at")
