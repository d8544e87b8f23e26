"""Structured Streaming jobs: feeds as they arrive, live volume and a token bucket per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..operators.merge import bucket_of, newest_buckets, upsert_postings, write_buckets
from ..scratch import settle

LATE = "10 minutes"


def stream_feeds(spark: SparkSession, folder: str, reader: Callable[[DataFrame], DataFrame], state_path: str, checkpoint: str, as_of: Column, buckets: int = 64) -> None:
    """Merges all feed files that have arrived in ``folder`` into the postings under ``state_path``, then stops.

    The state is kept in hash buckets of the url. A batch reads and rewrites the buckets that it touches, as their next version
    named by its batch id, so a batch that is run again after a failure replaces its own and sees what it saw before. Of a touched
    bucket the version before stays too, the older ones go. ``feed_state`` reads the newest versions.
    """
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    payloads = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("slug"), F.col("value").alias("body"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = settle(reader(batch).filter(F.col("url").isNotNull()), "feed-batch")
        touched = [r[0] for r in fresh.select(bucket_of("url", buckets)).distinct().collect()]  # one number a bucket at most
        if not touched:
            return
        try:
            before = spark.read.parquet(state_path).filter(F.col("bucket").isin(touched))
            current = newest_buckets(before, before=batch_id)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            before, current = None, fresh.limit(0).withColumns({"id": F.lit(None).cast("string"), "first_seen_at": F.lit(None).cast("timestamp"), "last_seen_at": F.lit(None).cast("timestamp")})
        old = [] if before is None else [(r["bucket"], r["version"]) for r in before.filter(F.col("version") < batch_id).select("bucket", "version").distinct().collect()]
        # of a batch's rows with one url the order of their content decides, the same in every run
        merged = upsert_postings(current, fresh, as_of, order=[F.xxhash64(*fresh.columns)])
        write_buckets(merged, state_path, buckets=buckets, version=batch_id)
        newest = {b: max(v for c, v in old if c == b) for b, _ in old}
        for b, v in old:
            if v < newest[b]:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/bucket={b}/version={v}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    query = payloads.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def feed_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The postings that ``stream_feeds`` keeps."""
    return newest_buckets(spark.read.parquet(state_path))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.EVENT_STREAM).parquet(folder)


def stream_volume(events: DataFrame, at: str = "ts", width: str = "1 hour") -> DataFrame:
    """(hour, n) of a stream of searches by clock hour; rows more than ten minutes late are dropped."""
    return events.withWatermark(at, LATE).groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")


class _Counter(StatefulProcessor):
    """The current window of one key, from the clock or from its first request on, and how many of its requests were seen."""

    def __init__(self, limit: int, seconds: int, anchored: bool):
        self.limit, self.window, self.anchored = limit, seconds * 1_000_000, anchored

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if not frames:
            return
        batch = pd.concat(frames).sort_values(["ts_us", "event_id"])
        start, n = self.state.get() if self.state.exists() else (None, 0)
        allowed = []
        for ts in batch["ts_us"].tolist():
            if start is None:
                start = ts if self.anchored else ts - ts % self.window
            passed = (ts - start) // self.window
            if passed > 0:
                start, n = start + passed * self.window, 0
            allowed.append(n < self.limit)
            n += 1
        self.state.update((start, n))
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"], "allowed": allowed})

    def close(self) -> None:
        pass


class _Expiring(_Counter):
    """A counter whose key is forgotten when it has sent nothing for some time."""

    def __init__(self, limit: int, seconds: int, anchored: bool, idle_seconds: int):
        super().__init__(limit, seconds, anchored)
        self.idle = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start bigint, n bigint", self.idle)


def _limited(requests: DataFrame, limit: int, seconds: int, anchored: bool, idle_seconds: int | None) -> DataFrame:
    counter = _Counter(limit, seconds, anchored) if idle_seconds is None else _Expiring(limit, seconds, anchored, idle_seconds)
    return requests.groupBy("key").transformWithStateInPandas(counter, outputStructType="key bigint, event_id bigint, allowed boolean", outputMode="Append", timeMode="None" if idle_seconds is None else "ProcessingTime")


def stream_token_bucket(requests: DataFrame, tokens: int = 10, seconds: int = 60, idle_seconds: int | None = None) -> DataFrame:
    """(key, event_id, allowed) of a stream of requests (key, event_id, ts_us): the batch operator's rule, with a window
    kept per key. With ``idle_seconds`` a key that has sent nothing for so long, by the machine's clock, starts anew. Needs the
    RocksDB state store."""
    return _limited(requests, tokens, seconds, True, idle_seconds)


def stream_fixed_window(requests: DataFrame, limit: int = 100, seconds: int = 86_400, idle_seconds: int | None = None) -> DataFrame:
    """(key, event_id, allowed) of a stream of requests: the first ``limit`` of a key in each window of the clock. A request that is
    late for its window counts in the current one. Needs the RocksDB state store."""
    return _limited(requests, limit, seconds, False, idle_seconds)


class _Recent(StatefulProcessor):
    """The times of a key's requests within the window that ends with its newest."""

    def __init__(self, limit: int, seconds: int, idle_seconds: int | None):
        self.limit, self.window, self.idle = limit, seconds * 1_000_000, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("times", "ts bigint", *([] if self.idle is None else [self.idle * 1000]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:  # a frame at a time: what is kept is a window's times, not a batch's rows
            if not len(batch):
                continue
            batch = batch.sort_values(["ts_us", "event_id"])
            at = batch["ts_us"].to_numpy()
            held = np.sort(np.concatenate((np.fromiter((t[0] for t in self.state.get()), np.int64), at)))
            n = np.searchsorted(held, at, side="right") - np.searchsorted(held, at - self.window, side="right")
            self.state.put([(int(t),) for t in held[held > held[-1] - self.window]])
            yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"], "n": n, "allowed": n <= self.limit})

    def close(self) -> None:
        pass


def stream_sliding_window(requests: DataFrame, limit: int = 10, seconds: int = 60, idle_seconds: int | None = None) -> DataFrame:
    """(key, event_id, n, allowed) of a stream of requests: how many of the key's requests, as far as they have arrived, lie in the window
    that ends with each. A key's state is the times of its last window; with ``idle_seconds`` it goes when nothing has come for so
    long, by the machine's clock. A request that is late by more than a window sees only what is kept. Needs the RocksDB state store."""
    schema = "key bigint, event_id bigint, n bigint, allowed boolean"
    return requests.groupBy("key").transformWithStateInPandas(_Recent(limit, seconds, idle_seconds), outputStructType=schema, outputMode="Append", timeMode="None" if idle_seconds is None else "ProcessingTime")
