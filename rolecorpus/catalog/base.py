"""The registry, and pieces of DuckDB SQL that several checks use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters, dims
from ..adapters import AS_OF_S, ORDERS_AS_OF_S, duck, logical

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
__all__ = ["AS_OF_S", "ORACLES", "ORDERS_AS_OF_S", "QUERIES", "adapters", "dims", "duck", "logical", "now", "orders_now", "query", "read", "seconds", "sql_content", "sql_list", "sql_values"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def now() -> Column:
    """The fixed clock of the checks."""
    return F.timestamp_seconds(F.lit(AS_OF_S))


def orders_now() -> Column:
    """The clock of tables made from orders."""
    return F.timestamp_seconds(F.lit(ORDERS_AS_OF_S))


def seconds(at: Column) -> Column:
    return F.unix_seconds(at)


def quoted(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def sql_values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(quoted(v) for v in row) + ')' for row in rows)}) AS t({names})"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_content(x: str) -> str:
    """Lower case, anything but letters and digits to single spaces."""
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
