"""Append tables of the monitor.

Every sink appends immutable files; nothing that may be read at the same time is rewritten.
Ids are natural keys made from the row, not counters, so a repeated task cannot skip one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(batch: DataFrame, path: str, ts: str, partition: str = "event_date") -> None:
    """Append a batch to the production log, one folder per event date.

    Rows are gathered by date first, so that a batch writes few files per date; AQE splits a
    date that holds most of the batch.
    """
    dated = batch.withColumn(partition, F.to_date(ts))
    dated.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def drift_check_rows(reports: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Persisted form of drift reports: scalar columns, and the whole report as JSON.

    A missing PSI is stored as 0 and a missing status as ok.
    """
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in id_columns])
    return reports.select(
        key.alias("id"),
        F.col("ts"),
        F.coalesce("status", F.lit("ok")).alias("status"),
        F.coalesce("psi_max", F.lit(0.0)).alias("psi_max"),
        F.coalesce("psi_mean", F.lit(0.0)).alias("psi_mean"),
        "perf_f1",
        "perf_drop",
        "window_start",
        "window_end",
        F.to_json(F.struct("*")).alias("report"),
    )


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def put_rows(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows of one event, named by its key; the same event again replaces its rows."""
    rows.write.mode("overwrite").parquet(f"{path}/event={hashlib.md5(key.encode()).hexdigest()}")


def verdict_rows(verdicts: DataFrame) -> DataFrame:
    """Verdicts as stored: text, nested recommendations, and the flag as 0 or 1."""
    return verdicts.withColumn(
        "triggered_retraining", F.coalesce(F.col("triggered_retraining").cast("int"), F.lit(0))
    )


def run_rows(
    df: DataFrame, run_id: Column, metrics: Sequence[str], tags: Sequence[str]
) -> DataFrame:
    """Experiment-run record: metrics without the missing ones, and text tags."""

    def pairs(names: Sequence[str], kind: str) -> Column:
        return F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast(kind) for n in names])
        )

    return df.select(
        run_id.alias("run_id"),
        F.map_filter(pairs(metrics, "double"), lambda _, v: v.isNotNull()).alias("metrics"),
        F.transform_values(
            pairs(tags, "string"), lambda _, v: F.coalesce(v, F.lit(""))
        ).alias("tags"),
    )


def save_reference(df: DataFrame, root: str, version: int, again: bool = False) -> str:
    """A new version folder; the previous one stays readable. `again` replaces what a failed try left."""
    path = f"{root}/v={version}"
    df.write.mode("overwrite" if again else "errorifexists").parquet(path)
    return path


REGISTRY = "model string, version string, alias string, reference_path string"
MOVES = "model string, alias string, version string, seq bigint, move string"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an append table; none while nothing was appended."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def is_registered(spark: SparkSession, path: str, model: str, version: int) -> bool:
    rows = stored(spark, path, REGISTRY)
    return not rows.where((F.col("model") == model) & (F.col("version") == str(version))).isEmpty()


def register_version(
    spark: SparkSession, path: str, model: str, version: int, alias: str | None, reference: str
) -> None:
    """One pointer row in the model registry; the same version again replaces its row.

    It is the commit of a version: whatever else belongs to it is written before."""
    row = spark.createDataFrame([(model, str(version), alias, reference)], REGISTRY)
    put_rows(row, path, f"{model}|{version}")


def move_alias(spark: SparkSession, path: str, model: str, alias: str, version: int | None, event: str) -> int:
    """Point an alias of a model at a version, or at none; returns the move's place in the log.

    The log keeps every move, numbered from 1 for each (model, alias). `event` names the move: the same
    event again keeps its number, so a retry moves nothing. One job at a time moves an alias."""
    moves = stored(spark, path, MOVES).where((F.col("model") == model) & (F.col("alias") == alias))
    known = moves.agg(F.max("seq").alias("last"), F.max(F.when(F.col("move") == event, F.col("seq"))).alias("own")).first()
    seq = known["own"] or (known["last"] or 0) + 1
    row = spark.createDataFrame([(model, alias, None if version is None else str(version), seq, event)], MOVES)
    put_rows(row, path, f"{model}|{alias}|{event}")
    return seq


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
