"""The result store kept by day: look-ups read the days that can still be live, purges drop whole days.

A result lies in the partition of the period in which it was stored: a day of UTC, or another length that every call names (``period_s``). Storing a query again writes the new
result into its own day and leaves the old one where it is: the newest result of a query hash stands, and old ones go with their day.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..scratch import settle
from .merge import merge
from .store import lookup_by_raw as flat_lookup_by_raw
from .store import ranked_results, since


DAY_S = 86_400


def day_of(at: Column, period_s: int = DAY_S) -> Column:
    """The number of the period, counted from 1970."""
    return F.floor(F.unix_seconds(at) / period_s).cast("int")


def write_days(results: DataFrame, path: str, files: int = 8, period_s: int = DAY_S) -> None:
    """Replaces the days that ``results`` (query_hash, created_at, ...) have rows of. A day's rows are spread over ``files`` files, so no
    task writes a whole day."""
    dated = results.withColumn("day", day_of(F.col("created_at"), period_s))
    spread = dated.repartition("day", F.pmod(F.xxhash64("query_hash"), F.lit(files)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, from_: Column | None = None, period_s: int = DAY_S) -> DataFrame:
    """All results of the days from that of ``from_`` on, old ones of a query hash too, with ``day``. The filter prunes partitions."""
    found = spark.read.parquet(path)
    return found if from_ is None else found.filter(F.col("day") >= day_of(from_, period_s))


def newest(results: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_hash").orderBy(F.desc("created_at"))
    return results.withColumn("store_rank", F.row_number().over(w)).filter("store_rank = 1").drop("store_rank", "day")


def lookup_by_hash(spark: SparkSession, path: str, queries: DataFrame, as_of: Column, ttl_hours: int = dims.STORE_TTL_HOURS, period_s: int = DAY_S) -> DataFrame:
    """As ``store.lookup_by_hash``: only live days are read, only the asked hashes are ranked."""
    asked = queries.select("query_hash").distinct().join(read_days(spark, path, since(as_of, ttl_hours), period_s), "query_hash")
    return newest(asked).filter(F.col("created_at") >= since(as_of, ttl_hours))


def lookup_by_raw(spark: SparkSession, path: str, queries: DataFrame, as_of: Column, ttl_hours: int = dims.STORE_TTL_HOURS, period_s: int = DAY_S) -> DataFrame:
    """As ``store.lookup_by_raw`` over the newest result of each query hash of the live days."""
    return flat_lookup_by_raw(queries, newest(read_days(spark, path, since(as_of, ttl_hours), period_s)), as_of, ttl_hours)


def store_results(spark: SparkSession, path: str, results: DataFrame, as_of: Column, period_s: int = DAY_S) -> None:
    """Stores ranked results as ``store.store_results`` does, reading and rewriting the day of ``as_of`` alone. Storing the same
    results again changes nothing."""
    batch = ranked_results(results).withColumn("created_at", as_of)
    try:
        today = read_days(spark, path).filter(F.col("day") == day_of(as_of, period_s)).drop("day")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        today = batch.limit(0)
    write_days(settle(merge(today, batch, ["query_hash"], {}), "store-today"), path, period_s=period_s)


def purge(spark: SparkSession, path: str, as_of: Column, days: int = dims.STORE_PURGE_DAYS, period_s: int = DAY_S) -> int:
    """Removes what was stored more than ``days`` days ago and says how many query hashes lose their result.

    Days before the limit's go as folders; the limit's own day alone is rewritten. Every step can be run again after a failure."""
    limit = since(as_of, 24 * days)
    boundary = spark.range(1).select(day_of(limit, period_s)).first()[0]
    found = spark.read.parquet(path)
    old = found.filter((F.col("day") <= boundary) & (F.col("created_at") < limit)).select("query_hash").distinct()
    live = found.filter((F.col("day") >= boundary) & (F.col("created_at") >= limit)).select("query_hash")
    lost = old.join(live, "query_hash", "left_anti").count()
    edge = found.filter(F.col("day") == boundary)
    mixed = settle(edge.filter(F.col("created_at") >= limit).drop("day"), "store-edge")
    gone = boundary
    if mixed.limit(1).count():
        write_days(mixed, path, period_s=period_s)
        gone = boundary - 1
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(root):  # one folder a day
        name, _, day = entry.getPath().getName().partition("=")
        if name == "day" and int(day) <= gone:
            fs.delete(entry.getPath(), True)
    spark.catalog.refreshByPath(path)
    return lost
