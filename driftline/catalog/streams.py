"""Streaming queries, run once over all that has arrived and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.catalog import sql as q
from driftline.catalog.drift import EV_REF
from driftline.catalog.history import COOLDOWN_MINUTES, cooldown_sql
from driftline.functions.scalars import hash_uniform, out
from driftline.operators.performance import f1_at_threshold
from driftline.operators.profile import build_profile
from driftline.plans import datasets as ds
from driftline.session import scratch_path
from driftline.streaming import common
from driftline.streaming.cooldown import (
    cooldown_batches,
    cooldown_in_event_time,
    open_decisions,
    read_decisions,
    retrain_cooldown_stream,
)
from driftline.streaming.label_f1 import labelled_predictions, scores_by_day, write_labelled
from driftline.streaming.window_psi import (
    pane_counts,
    read_panes,
    read_running,
    sliding_psi,
    write_panes,
    write_running,
)

STATE_PARTITIONS = 8
MAX_DELAY_HOURS = 80


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return common.event_stream(spark, folder, "events.parquet", common.EVENT_SCHEMA, "ts")


def stream_window_psi(spark: SparkSession, folder: str) -> DataFrame:
    ref, _ = ds.split(ds.scored_events(spark, folder), "ts", ds.EVENT_SPLIT)
    built = build_profile(ref, ds.EVENT_FEATURES)
    own = common.stateful_session(spark, STATE_PARTITIONS)
    raw = _events(own, folder).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    path = scratch_path(spark, "panes")
    write_panes(
        pane_counts(raw, ds.EVENT_FEATURES, built, "ts", "1 hour"), path, scratch_path(spark, "panes-state")
    )
    panes = read_panes(spark, path)
    return sliding_psi(panes, built).select(
        F.to_timestamp_ntz(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).alias("window_start"),
        "feature", out(F.col("psi")).alias("psi"),
    )


def stream_label_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Labels come 0 to 80 hours late by hash, which the join's bound covers; two in a hundred
    never come, and their predictions are counted as unmatched."""
    own = common.stateful_session(spark, STATE_PARTITIONS)
    raw = _events(own, folder).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    scores = raw.select("event_id", "ts", ds.event_score(F.col("value"), F.col("k")).alias("score"))
    late = F.floor(hash_uniform(["event_id"], "delay") * F.lit(80.0 * 3600.0))
    labels = raw.select(
        "event_id",
        (F.col("ts") + F.make_dt_interval(secs=late)).alias("label_ts"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
    ).filter(hash_uniform(["event_id"], "lost") >= 0.02)
    path, counts = scratch_path(spark, "labelled"), scratch_path(spark, "scores-by-day")
    joined = labelled_predictions(scores, labels, "event_id", f"{MAX_DELAY_HOURS} HOURS", "1 hour", unmatched=True)
    write_labelled(joined, path, scratch_path(spark, "labelled-state"))
    write_running(
        scores_by_day(scores, "1 hour"), ["day"], "n_samples", "day", counts, scratch_path(spark, "scores-by-day-state")
    )
    # Scores that the stream gave up have no label; those of the last days are still waiting.
    table = spark.read.parquet(path).where("label is not null").withColumn("day", F.to_date("ts"))
    found = f1_at_threshold(table, ds.DECISION_THRESHOLD, ["day"]).drop("n_samples")
    made = read_running(spark, ["day"], "n_samples", counts)
    matched = F.coalesce("n_labeled", F.lit(0))
    return made.join(found, "day", "left").select(
        "day", "n_samples", matched.alias("n_labeled"), (F.col("n_samples") - matched).alias("n_unmatched"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
        out(F.coalesce("f1", F.lit(0.0))).alias("f1"),
    )


def stream_retrain_cooldown(spark: SparkSession, folder: str) -> DataFrame:
    own = common.stateful_session(spark, STATE_PARTITIONS)
    asked = _events(own, folder).filter("event_type = 'purchase' AND value >= 20").select(
        F.col("user_id").alias("model"), F.col("event_id").alias("request_id"),
        F.unix_micros("ts").alias("at"),
    )
    path = scratch_path(spark, "cooldown")
    common.run_available(
        retrain_cooldown_stream(asked, COOLDOWN_MINUTES)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", scratch_path(spark, "cooldown-state"))
    )
    return spark.read.parquet(path).select(F.col("request_id").alias("event_id"), "model", "dispatched")


def stream_cooldown_batches(spark: SparkSession, folder: str) -> DataFrame:
    own = common.stateful_session(spark, STATE_PARTITIONS)
    asked = _events(own, folder).filter("event_type = 'purchase' AND value >= 20").select(
        F.col("user_id").alias("model"), "event_id", "ts"
    )
    path = scratch_path(spark, "cooldown")
    common.run_available(
        cooldown_batches(asked, COOLDOWN_MINUTES, path).option(
            "checkpointLocation", scratch_path(spark, "cooldown-state")
        )
    )
    return read_decisions(spark, path).select("event_id", "model", "dispatched")


def stream_cooldown_event_time(spark: SparkSession, folder: str) -> DataFrame:
    """What the stream has decided up to its watermark, and what it would decide of the rest."""
    own = common.stateful_session(spark, STATE_PARTITIONS)
    asked = _events(own, folder).filter("event_type = 'purchase' AND value >= 20").select(
        F.col("user_id").alias("model"), "event_id", "ts"
    )
    path = scratch_path(spark, "cooldown")
    common.run_available(
        cooldown_in_event_time(asked, COOLDOWN_MINUTES, 60, path).option(
            "checkpointLocation", scratch_path(spark, "cooldown-state")
        )
    )
    columns = ["event_id", "model", "dispatched"]
    waiting = open_decisions(spark, path, COOLDOWN_MINUTES).select(*columns)
    return read_decisions(spark, path).select(*columns).unionByName(waiting)


QUERIES = {
    "stream_window_psi": stream_window_psi,
    "stream_label_f1": stream_label_f1,
    "stream_retrain_cooldown": stream_retrain_cooldown,
    "stream_cooldown_batches": stream_cooldown_batches,
    "stream_cooldown_event_time": stream_cooldown_event_time,
}

SLID = f"""SELECT date_trunc('hour', ts) - to_hours(CAST(h AS INTEGER)) AS window_start, value, k
  FROM ({ds.EVENTS_SQL}), (SELECT unnest(range(0, 24)) AS h)"""
DELAY = f"CAST(floor({ds.uniform_sql('event_id', 'delay')} * (80.0::DOUBLE * 3600.0::DOUBLE)) AS BIGINT)"
LOST = f"{ds.uniform_sql('event_id', 'lost')} < 0.02::DOUBLE"
TIMELY = f"""SELECT CAST(ts AS DATE) AS day, {ds.score_sql()} AS score,
    CASE WHEN NOT {LOST} AND {DELAY} <= {MAX_DELAY_HOURS} * 3600 THEN CAST(event_type = 'purchase' AS INTEGER) END AS label
  FROM ({ds.EVENTS_SQL})"""
ORACLES = {
    "stream_window_psi": f"""WITH {q.psi_ctes(EV_REF, SLID, ds.EVENT_FEATURES, windows=['window_start'])}
      SELECT window_start, feature, {q.rounded('psi')} FROM psi""",
    "stream_label_f1": f"""SELECT day, n_samples, n_labeled, n_samples - n_labeled AS n_unmatched, tp, fp, fn,
        round(f1, 6) + 0.0::DOUBLE AS f1
      FROM ({q.confusion_sql(TIMELY, str(ds.DECISION_THRESHOLD), ['day'])})""",
    "stream_retrain_cooldown": f"""WITH RECURSIVE asked AS (
        SELECT event_id, ts, user_id AS model FROM events WHERE event_type = 'purchase' AND value >= 20),
      {cooldown_sql('sent', 'asked', 'model', COOLDOWN_MINUTES)}
      SELECT event_id, model, sent_at IS NOT NULL AS dispatched
      FROM asked LEFT JOIN sent ON model = k AND ts = sent_at""",
}
ORACLES["stream_cooldown_batches"] = ORACLES["stream_retrain_cooldown"]
ORACLES["stream_cooldown_event_time"] = ORACLES["stream_retrain_cooldown"]
