"""Scans and windows over reference tables and the production log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None
) -> DataFrame:
    """One Parquet table; with a declared schema no footer is read for inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def moment(value: datetime, like: T.DataType) -> Column:
    """A time literal of the column's own type, independent of the session zone for
    timestamp_ntz; without a cast on the column side it can be pushed to the scan."""
    if isinstance(like, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(like)
    return F.lit(value)


def latest(log: DataFrame, ts: str, partition: str | None = None):
    """Newest event time of a log, or None when it is empty.

    On a log partitioned by date only the newest partition's time column is read.
    """
    if partition is not None:
        newest = log.agg(F.max(partition)).first()[0]
        if newest is None:
            return None
        log = log.filter(F.col(partition) == F.lit(newest))
    return log.agg(F.max(ts)).first()[0]


def lookback_window(
    log: DataFrame, ts: str, hours: int, partition: str | None = None
) -> DataFrame:
    """Rows with ts >= newest ts - hours (inclusive), anchored on data time.

    The cutoff is a literal in the plan, so it is pushed to the Parquet scan, and on a
    partitioned log it prunes whole dates.
    """
    newest = latest(log, ts, partition)
    return log if newest is None else since(log, ts, newest - timedelta(hours=hours), partition)


def since(log: DataFrame, ts: str, cutoff: datetime, partition: str | None = None) -> DataFrame:
    """Rows from the cutoff on; a log partitioned by date skips whole dates."""
    recent = log.filter(F.col(ts) >= moment(cutoff, log.schema[ts].dataType))
    return recent if partition is None else recent.filter(F.col(partition) >= F.lit(cutoff.date()))


def legacy_union_window(
    legacy: DataFrame | None, parts: DataFrame, ts: str, hours: int, partition: str | None = None
) -> DataFrame:
    """Lookback over the older single table and the newer parts together.

    The newest time of both gives the one literal cutoff that reaches both scans; `partition`
    is the date column of the parts.
    """
    if legacy is None:
        return lookback_window(parts, ts, hours, partition)
    known = [t for t in (latest(legacy, ts), latest(parts, ts, partition)) if t is not None]
    if known:
        cutoff = max(known) - timedelta(hours=hours)
        legacy, parts = since(legacy, ts, cutoff), since(parts, ts, cutoff, partition)
    return legacy.unionByName(parts, allowMissingColumns=True)


def empty_log(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
