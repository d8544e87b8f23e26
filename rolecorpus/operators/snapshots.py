"""State of owner logs from a kept snapshot and the log's tail.

The newest event of a key is a maximum, so it can be taken piece by piece: a snapshot holds the newest event of each key up to a
segment of the log, set or unset (an event that arrives late may be older than an unset one), and the state is the newest of the
snapshot's and the tail's. Both are partitioned: the log by segments of event ids, which ascend as events are added (their times needn't), the snapshot by hash
buckets of the owner. Take a snapshot of segments that are closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import bucket_of
from .owners import live, newest_events

SEGMENT_EVENTS = 10_000_000


def append_log(events: DataFrame, path: str, segment_events: int = SEGMENT_EVENTS) -> None:
    """Adds events (event_id, owner, ...) to the log, by segment of their id."""
    events.withColumn("segment", F.floor(F.col("event_id") / segment_events).cast("int")).write.mode("append").partitionBy("segment").parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The snapshots that were written to their end, ascending: each is named by the first segment that it doesn't hold."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [e.getPath() for e in fs.listStatus(root) if e.getPath().getName().startswith("upto=")]
    return sorted(int(p.getName()[5:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _newest(spark: SparkSession, log_path: str, path: str, key: list[str], upto: int | None, owners: list | None, buckets: int) -> DataFrame:
    """The newest event of each key from the latest fitting snapshot and the segments after it. Only those segments are read, and of
    the snapshot only the asked owners' buckets."""
    at = max((v for v in versions(spark, path) if upto is None or v <= upto), default=None)
    tail = spark.read.parquet(log_path)
    tail = tail if at is None else tail.filter(F.col("segment") >= at)
    tail = tail if upto is None else tail.filter(F.col("segment") < upto)
    if owners is not None:
        tail = tail.filter(F.col("owner").isin(owners))
    events = newest_events(tail.drop("segment"), key)
    if at is None:
        return events
    kept = spark.read.parquet(f"{path}/upto={at}")
    if owners is not None:
        asked = spark.createDataFrame([(o,) for o in owners], f"owner {dict(tail.dtypes)['owner']}")
        among = [r[0] for r in asked.select(bucket_of("owner", buckets)).distinct().collect()]
        kept = kept.filter(F.col("bucket").isin(among) & F.col("owner").isin(owners))
    return newest_events(kept.select(*events.columns).union(events), key)


def take_snapshot(spark: SparkSession, log_path: str, path: str, key: list[str], upto: int, buckets: int = 64) -> None:
    """Writes the snapshot of the segments below ``upto``, from the one before and the segments in between. ``key`` begins with the owner."""
    state = _newest(spark, log_path, path, key, upto, None, buckets).withColumn("bucket", bucket_of("owner", buckets))
    state.repartition("bucket", F.pmod(F.xxhash64(*key), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/upto={upto}")


def state(spark: SparkSession, log_path: str, path: str, key: list[str], owners: list | None = None, buckets: int = 64) -> DataFrame:
    """What ``owners.replay`` of the whole log gives, of all owners or of some. ``buckets`` is what the snapshots were taken with."""
    return live(_newest(spark, log_path, path, key, None, owners, buckets))
