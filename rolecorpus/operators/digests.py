"""Saved searches: which are due, what is new since the last run, whom to tell, and what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .merge import merge


def _before(as_of: Column, cadence: Column) -> Column:
    """The time before which a search of this cadence is due again."""
    return F.when(cadence == "daily", as_of - F.make_dt_interval(days=F.lit(1))).when(cadence == "weekly", as_of - F.make_dt_interval(days=F.lit(7)))


def due_searches(searches: DataFrame, as_of: Column) -> DataFrame:
    cadence, last = F.col("cadence"), F.col("last_run_at")
    return searches.filter((cadence != "off") & (last.isNull() | (last < _before(as_of, cadence))))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run (search_id, run_id, created_at, ids) of each search; ties to the larger run id."""
    return runs.groupBy("search_id").agg(F.max_by(F.struct("run_id", "created_at", "ids"), F.struct("created_at", "run_id")).alias("r")).select("search_id", "r.*")


def search_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(search_id, ids, delta, is_first, write_run): the current ids (search_id, ids) that the last run had not, in order and with
    repeats; nothing is new on a first run; a run is written on the first one or if something is new."""
    both = current.join(previous.select("search_id", F.col("ids").alias("before")), "search_id", "left")
    # what is new is few; only that is looked through for each id
    new = let(F.array_except("ids", "before"), lambda fresh: F.filter("ids", lambda x: F.array_contains(fresh, x)))
    first = F.col("before").isNull()
    return both.select("search_id", "ids", F.when(first, F.slice("ids", 1, 0)).otherwise(new).alias("delta"), first.alias("is_first")).withColumn("write_run", F.col("is_first") | (F.size("delta") > 0))


def notify_candidates(deltas: DataFrame, searches: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """(search_id, target, n_new) for searches with news whose owner was last told before the cadence's boundary or never."""
    due = F.col("last_notified_at").isNull() | (F.col("last_notified_at") < _before(as_of, F.col("cadence")))
    both = deltas.filter("not is_first and size(delta) > 0").join(searches, "search_id").filter(due)
    mail = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    return both.join(mail, "user_id", "left").select("search_id", F.coalesce("notify_email", "user_email").alias("target"), F.size("delta").alias("n_new"), "delta")


def digest_payload(notices: DataFrame, postings: DataFrame, most: int = 5) -> DataFrame:
    """(search_id, n_new, items): the first ``most`` new postings that are known, in order."""
    rows = notices.select("search_id", "n_new", F.posexplode("delta").alias("pos", "id")).join(postings.select("id", "title", "company", "url"), "id")
    w = Window.partitionBy("search_id").orderBy("pos")
    top = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    item = F.struct("r", "title", F.coalesce("company", F.lit("Unknown Company")).alias("company"), "url")
    return top.groupBy("search_id", "n_new").agg(F.array_sort(F.collect_list(item)).alias("items"))


def advance_state(searches: DataFrame, ran: DataFrame, sent: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Searches with the time of the run, and of the notice for those it was sent for; and the events to append."""
    marks = ran.select("search_id", F.lit(True).alias("did_run")).join(sent.select("search_id", F.lit(True).alias("did_send")), "search_id", "left")
    both = searches.join(marks, "search_id", "left")
    state = both.withColumns({"last_run_at": F.when(F.col("did_run"), as_of).otherwise(F.col("last_run_at")), "last_notified_at": F.when(F.col("did_send"), as_of).otherwise(F.col("last_notified_at"))}).drop("did_run", "did_send")
    events = ran.select("search_id", F.lit("saved_search_run_completed").alias("evt")).unionByName(sent.select("search_id", F.lit("digest_email_sent").alias("evt"))).withColumn("created_at", as_of)
    return state, events


def upsert_saved(saved: DataFrame, requests: DataFrame, most: int = 50) -> DataFrame:
    """Saved searches (owner, query_hash, cadence, email, is_anon, created_at) with requests merged by owner and hash, and the newest
    ``most`` of each owner. Requests of an unknown cadence go, and anonymous ones that want mail without an address."""
    fine = F.col("cadence").isin("off", "daily", "weekly") & ((F.col("cadence") == "off") | ~F.col("is_anon") | F.coalesce(F.col("email") != "", F.lit(False)))
    w = Window.partitionBy("owner", "query_hash").orderBy(F.desc("created_at"))
    unique = requests.filter(fine).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    state = merge(saved, unique, ["owner", "query_hash"], {"created_at": "keep"})
    newest = Window.partitionBy("owner").orderBy(F.desc("created_at"), "query_hash")
    return state.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)
