"""Queries on scans, sinks and row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalars import hash_uniform, out
from driftline.operators import quality
from driftline.plans import datasets as ds
from driftline.session import scratch_path
from driftline.sources import sinks
from driftline.sources.tables import legacy_union_window, lookback_window, read_table

EVENT_COLUMNS = ["event_id", "ts", "event_type", "value"]


def lookback(spark: SparkSession, folder: str) -> DataFrame:
    return lookback_window(read_table(spark, folder, "events"), "ts", 24).select(*EVENT_COLUMNS)


def legacy_union(spark: SparkSession, folder: str) -> DataFrame:
    """Click events play the older log, which lacks the type column."""
    events = read_table(spark, folder, "events")
    legacy = events.filter("event_type = 'click'").select("event_id", "ts", "value")
    parts = events.filter("event_type <> 'click'").select(*EVENT_COLUMNS)
    return legacy_union_window(legacy, parts, "ts", 24).select(*EVENT_COLUMNS)


def log_append_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Append a clean and a drifted batch, then look back over the partitioned log."""
    path = scratch_path(spark, "log")
    columns = ["event_id", "ts", "value", "k", "label"]
    ref, prod = ds.split(ds.drifting_events(spark, folder), "ts", ds.EVENT_SPLIT)
    sinks.append_log(ref.select(*columns), path, "ts")
    sinks.append_log(prod.select(*columns), path, "ts")
    schema = "event_id bigint, ts timestamp_ntz, value double, k double, label int, event_date date"
    log = sinks.read_log(spark, path, schema)
    window = lookback_window(log, "ts", 240, partition="event_date")
    return window.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), out(F.sum("value"), 3).alias("total_value")
    )


FEATURES = ["balance", "segment", "nation"]


def schema_conformance(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as scoring requests: some lack a feature, some carry an unknown one."""
    c = read_table(spark, folder, "customer")
    pairs = F.array(
        F.when(F.col("c_acctbal") >= 0, F.struct(F.lit("balance").alias("key"), F.col("c_acctbal").alias("value"))),
        F.struct(F.lit("segment").alias("key"), F.length("c_mktsegment").cast("double").alias("value")),
        F.struct(F.lit("nation").alias("key"), F.col("c_nationkey").cast("double").alias("value")),
        F.when(F.col("c_nationkey") == 3, F.struct(F.lit("debug").alias("key"), F.lit(1.0).alias("value"))),
    )
    requests = c.select("c_custkey", F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())).alias("instance"))
    return quality.map_conformance(requests, "instance", FEATURES).select(
        "c_custkey", F.array_join("missing", ",").alias("missing"),
        F.array_join("unknown", ",").alias("unknown"), "conforms",
    )


def finite_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Readings turned into NaN or infinity by hash, then sorted out again."""
    ev = ds.events(spark, folder)
    u = hash_uniform(["event_id"], "broken")
    broken = ev.select(
        "event_id",
        F.when(u < 0.02, F.lit(float("nan"))).when(u < 0.04, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"),
        F.when(u > 0.99, F.lit(float("-inf"))).otherwise(F.col("k")).alias("k"),
    )
    return quality.quarantine(broken, ["value", "k"]).select(
        "event_id", "quarantined", F.array_join("bad_features", ",").alias("bad_features")
    )


QUERIES = {
    "lookback_window": lookback,
    "legacy_union_window": legacy_union,
    "log_append_roundtrip": log_append_roundtrip,
    "schema_conformance": schema_conformance,
    "finite_quarantine": finite_quarantine,
}

U = ds.uniform_sql("event_id", "broken")
ORACLES = {
    "lookback_window": """SELECT event_id, ts, event_type, value FROM events
      WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""",
    "legacy_union_window": """SELECT event_id, ts, CASE WHEN event_type <> 'click' THEN event_type END AS event_type, value
      FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""",
    "log_append_roundtrip": f"""SELECT CAST(ts AS DATE) AS event_date, count(*) AS n,
        CAST(sum(label) AS BIGINT) AS positives, round(sum(value), 3) + 0.0::DOUBLE AS total_value
      FROM ({ds.DRIFTING_SQL}) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOUR GROUP BY 1""",
    "schema_conformance": """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN '' ELSE 'balance' END AS missing,
        CASE WHEN c_nationkey = 3 THEN 'debug' ELSE '' END AS unknown,
        c_acctbal >= 0 AND c_nationkey <> 3 AS conforms FROM customer""",
    "finite_quarantine": f"""SELECT event_id, u < 0.04 OR u > 0.99 AS quarantined,
        CASE WHEN u < 0.04 THEN 'value' WHEN u > 0.99 THEN 'k' ELSE '' END AS bad_features
      FROM (SELECT event_id, {U} AS u FROM events)""",
}
