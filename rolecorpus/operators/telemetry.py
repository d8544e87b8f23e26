"""Telemetry of searches over the event log, all at a given time, and rate-limit windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _within(as_of: Column, hours: int) -> Column:
    at = F.col("created_at")
    return (at > as_of - F.make_dt_interval(hours=F.lit(hours))) & (at <= as_of)


def _pct(n: Column, of: Column, places: int = 0) -> Column:
    scale = 10**places
    return F.when(of > 0, F.floor(100 * scale * n / of + 0.5) / scale).otherwise(F.lit(0.0))


def traffic(events: DataFrame, as_of: Column) -> DataFrame:
    """Searches of the last hour and day, the share from the store in the hour, of failed rankings in the day. One pass."""
    search = F.col("evt") == "search"
    h, d = search & _within(as_of, 1), search & _within(as_of, 24)
    c = events.filter(_within(as_of, 24)).agg(F.count_if(h).alias("searches_1h"), F.count_if(d).alias("searches_24h"), F.count_if(h & F.col("cache_hit")).alias("hits"), F.count_if(d & F.col("rerank_failed")).alias("fails"))
    return c.select("searches_1h", "searches_24h", _pct(F.col("hits"), F.col("searches_1h")).alias("hit_pct"), _pct(F.col("fails"), F.col("searches_24h"), 2).alias("fail_pct"))


#: Bits of a value that one pass over the rows resolves: a pass brings at most 2**RESOLVED counts for each asked rank to the driver.
RESOLVED = 10


def exact_percentiles(rows: DataFrame, value: str, subsets: dict[str, Column], asked: list[tuple[str, float]]) -> list[float | None]:
    """Interpolated percentiles (subset, share) of a whole-number column over subsets of the rows, None for an empty one.

    Ranks are selected by nested histograms: values are counted by range, and only the ranges that hold an asked rank are counted
    again, more finely, until a range is one value. No value is shuffled or sorted, only sums over ranges are, however many rows or
    distinct values there are. Nulls are left out.
    """
    held = rows.select(F.col(value).cast("long").alias("v"), *[F.coalesce(c, F.lit(False)).alias(f"in_{k}") for k, c in subsets.items()]).filter("v is not null")
    whole = held.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), *[F.count_if(f"in_{k}").alias(k) for k in subsets]).first()
    ranks = {(k, r) for k, q in asked if whole[k] for at in [(whole[k] - 1) * q] for r in (math.floor(at), math.ceil(at))}
    # of each asked rank: the range that holds it, and how many values of its subset stand before that range
    place, before = dict.fromkeys(ranks, 0), dict.fromkeys(ranks, 0)
    shift = max(0, ((whole.hi or 0) - (whole.lo or 0)).bit_length()) if ranks else 0
    while shift > 0:
        width = min(RESOLVED, shift)
        shift -= width
        off = F.expr(f"v - ({whole.lo})")
        finer = held.filter(F.shiftright(off, shift + width).isin(sorted(set(place.values())))).groupBy(F.shiftright(off, shift).alias("at"))
        counts = sorted(finer.agg(*[F.count_if(f"in_{k}").alias(k) for k in subsets]).collect(), key=lambda r: r["at"])
        for k, r in ranks:
            seen = before[k, r]
            for c in counts:
                if c["at"] >> width == place[k, r]:
                    if seen + c[k] > r:
                        place[k, r], before[k, r] = c["at"], seen
                        break
                    seen += c[k]
    out = []
    for k, q in asked:
        if not whole[k]:
            out.append(None)
            continue
        at = (whole[k] - 1) * q
        low, high = (place[k, r] + whole.lo for r in (math.floor(at), math.ceil(at)))
        out.append(float(low) if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out


def latency_percentiles(events: DataFrame, as_of: Column) -> DataFrame:
    """Exact interpolated percentiles of the total time of searches; 0 where there is none. Reads the events when it is called."""
    rows = events.filter((F.col("evt") == "search") & _within(as_of, 24))
    got = exact_percentiles(rows, "total_ms", {"hour": _within(as_of, 1), "day": F.lit(True)}, [("hour", 0.5), ("hour", 0.95), ("hour", 0.99), ("day", 0.95)])
    return events.sparkSession.createDataFrame([tuple(x or 0.0 for x in got)], "p50_1h double, p95_1h double, p99_1h double, p95_24h double")


def cost_24h(events: DataFrame, as_of: Column) -> DataFrame:
    from .scoring import llm_cost

    rows = events.filter((F.col("evt") == "search") & _within(as_of, 24))
    sums = rows.agg(F.coalesce(F.sum("search_usd"), F.lit(0.0)).alias("search_usd"), F.coalesce(F.sum(llm_cost(F.lit(0), F.col("tokens"))), F.lit(0.0)).alias("llm_usd"), F.count("*").alias("n"))
    return sums.select("search_usd", "llm_usd", F.coalesce(F.try_divide(F.col("search_usd") + F.col("llm_usd"), F.col("n")), F.lit(0.0)).alias("per_search"))


def hourly_volume(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(bucket, n): searches in buckets of an hour counted back from now, empty ones too; bucket 0 is the oldest."""
    age = (F.unix_micros(as_of) - F.unix_micros("created_at")) / 3.6e9
    counts = events.filter((F.col("evt") == "search") & (F.col("created_at") < as_of)).withColumn("bucket", (F.lit(hours) - F.ceil(age)).cast("int")).filter(F.col("bucket").between(0, hours - 1)).groupBy("bucket").agg(F.count("*").alias("n"))
    every = events.sparkSession.range(hours).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def hourly_by_clock(events: DataFrame) -> DataFrame:
    """(hour, n): searches by clock hour."""
    return events.filter("evt = 'search'").groupBy(F.window("created_at", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")


def stage_averages(events: DataFrame, as_of: Column) -> DataFrame:
    rows = events.filter((F.col("evt") == "search") & _within(as_of, 24))
    mean = lambda c: F.coalesce(F.floor(F.avg(c) + 0.5), F.lit(0)).cast("long")
    return rows.agg(mean("parse_ms").alias("parse_ms"), mean("total_ms").alias("total_ms"))


def event_counts(events: DataFrame, as_of: Column) -> DataFrame:
    return events.filter(_within(as_of, 24)).groupBy("evt").agg(F.count("*").alias("n"))


def recent_events(events: DataFrame, most: int = 50) -> DataFrame:
    """The newest events with the sums of their tokens and costs."""
    top = events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(most)
    whole = Window.partitionBy()
    return top.withColumns({"sum_tokens": F.sum(F.coalesce("tokens", F.lit(0))).over(whole), "sum_usd": F.sum(F.coalesce("search_usd", F.lit(0.0))).over(whole)})


def latest_eval(runs: DataFrame) -> DataFrame:
    """Rows of the run with the newest row, and its share of passes."""
    newest = runs.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    rows = runs.join(F.broadcast(newest), "run_id")  # one row
    w = Window.partitionBy("run_id")
    return rows.withColumn("pass_pct", F.floor(100 * F.count_if("passed").over(w) / F.count("*").over(w) + 0.5))


def rubric_drift(runs: DataFrame) -> DataFrame:
    g = runs.groupBy("rubric").agg(F.count("*").alias("n_rows"), F.count_distinct("run_id").alias("runs"), F.avg("score").alias("avg_score"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.min("created_at").alias("first_at"))
    return g.orderBy(F.desc("first_at"))


# ---- rate limits -------------------------------------------------------------------------------------


def fixed_window_limit(requests: DataFrame, limit: int = 100, seconds: int = 86_400) -> DataFrame:
    """Adds allowed: the first ``limit`` requests of a key in each window of the clock."""
    window = F.floor(F.col("ts_us") / (seconds * 1_000_000))
    w = Window.partitionBy("key", window).orderBy("ts_us", "event_id")
    return requests.withColumn("allowed", F.row_number().over(w) <= limit)


#: Windows in a slice of time: a slice's rows stand together, with the last window of the slice before as a halo.
SLICE = 16


def sliding_window_limit(requests: DataFrame, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Adds n, the key's requests in the half-open window that ends with each, and allowed, whether that is within the limit.

    A key's requests are dealt out by slices of time, so a key that sends a third of all is as many groups as it has slices. A
    request in the last window of a slice goes to the next one too, where it is counted and not returned.
    """
    width = seconds * 1_000_000
    own = F.expr(f"ts_us div {SLICE * width} - cast(ts_us % {SLICE * width} < 0 as int)")
    last = F.expr(f"pmod(ts_us, {SLICE * width}) >= {(SLICE - 1) * width}")
    taken = set(requests.columns)
    at, mine = (next(c for c in (name + "_" * k for k in range(len(taken) + 1)) if c not in taken) for name in ("slice", "own"))
    dealt = requests.withColumn(at, F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn(mine, F.col(at) == own)
    w = Window.partitionBy("key", at).orderBy("ts_us").rangeBetween(-(width - 1), 0)
    return dealt.withColumn("n", F.count("*").over(w)).filter(mine).drop(at, mine).withColumn("allowed", F.col("n") <= limit)


def token_bucket(requests: DataFrame, tokens: int = 10, seconds: int = 60) -> DataFrame:
    """(key, event_id, allowed): a bucket of ``tokens`` per key that is refilled for each whole window since its last
    refill. As a refill fills the bucket and moves on by whole windows, windows are counted from a key's first request, and the first
    ``tokens`` requests of each are allowed; the streaming twin keeps the same state. A key's requests are ranked by window,
    so a key that sends a third of all is as many groups as it has windows."""
    first = requests.groupBy("key").agg(F.min("ts_us").alias("bucket_first"))
    placed = requests.join(first, "key").withColumn("bucket_window", F.expr(f"(ts_us - bucket_first) div {seconds * 1_000_000}"))
    w = Window.partitionBy("key", "bucket_window").orderBy("ts_us", "event_id")
    return placed.select("key", "event_id", (F.row_number().over(w) <= tokens).alias("allowed"))
