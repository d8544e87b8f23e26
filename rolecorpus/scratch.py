"""Tables written in between, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a table is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rolecorpus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables written outside any scope, and the list that a new one is entered in.
_written: list[str] = []
_current: ContextVar[list[str]] = ContextVar("scratch", default=_written)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder for a table, remembered for the scope it is made in."""
    path = f"{scratch_dir(spark)}/{label}_{uuid.uuid4().hex}"
    _current.get().append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Removes the tables written in between by the scope it is called in, or those written outside any, and says how many. Call it
    when the results that read them have been written; what a stopped process leaves goes with the folder's own retention."""
    n, paths = 0, _current.get()
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """The tables that are written in between within it are removed at its end, and no others: jobs side by side, in threads or one
    within another, keep theirs. Write what reads them before the scope ends."""
    outer = _current.set([])
    try:
        yield
    finally:
        drop_scratch(spark)
        _current.reset(outer)


def settle(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there, so a lost
    executor costs a re-read and never a re-run, and nothing is computed twice."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes: texts and binaries by their bytes, other plain values 8, nested ones as JSON."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.octet_length(F.to_json(F.struct(c)))
        total = total + 8
    return total


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and about ``size`` bytes, else as it is: a shuffled join,
    whose skewed partitions the adaptive planner splits."""
    n, held = df.select(row_bytes(df).alias("b")).limit(rows + 1).agg(F.count("*"), F.sum("b")).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df
