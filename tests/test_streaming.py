from datetime import datetime, timedelta

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.drift import feature_psi
from driftline.operators.profile import build_profile
from driftline.streaming import common
from driftline.streaming.cooldown import cooldown_batches, read_decisions
from driftline.streaming.label_f1 import labelled_predictions, write_labelled
from driftline.streaming.window_psi import pane_counts, read_panes, sliding_psi, write_panes

BASE = datetime(2024, 1, 1)


def event_log(spark, path, n=600):
    """Two files, the second one later in time."""
    rng = np.random.default_rng(0)
    rows = [(i, BASE + timedelta(minutes=11 * i), float(v)) for i, v in enumerate(rng.normal(0, 1, n))]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, v double")
    df.filter(F.col("id") < n // 2).coalesce(1).write.mode("append").parquet(path)
    df.filter(F.col("id") >= n // 2).coalesce(1).write.mode("append").parquet(path)
    return df


SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("v", T.DoubleType())]
)


def test_sliding_windows_equal_the_batch_result(spark, tmp_path):
    df = event_log(spark, str(tmp_path / "log"))
    ref = spark.createDataFrame([(float(x),) for x in np.random.default_rng(1).normal(0, 1, 500)], "v double")
    profile = build_profile(ref, ["v"])
    own = common.stateful_session(spark, 4)
    stream = common.event_stream(own, str(tmp_path / "log"), "*.parquet", SCHEMA, "ts", files_per_trigger=1)
    write_panes(pane_counts(stream, ["v"], profile, "ts", "1 hour"), str(tmp_path / "panes"), str(tmp_path / "state"))
    got = {r["window_start"]: r["psi"] for r in sliding_psi(read_panes(spark, str(tmp_path / "panes")), profile).collect()}
    windows = df.select(F.window(F.col("ts").cast("timestamp"), "24 hours", "1 hour").alias("w"), "v")
    batch = feature_psi(windows.select(F.col("w.start").alias("window_start"), "v"), ["v"], profile, ["window_start"])
    expected = {r["window_start"]: r["psi"] for r in batch.collect()}
    assert set(got) == set(expected)
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_two_scheduled_runs_with_one_checkpoint(spark, tmp_path):
    log, panes, state = (str(tmp_path / n) for n in ("log", "panes", "state"))
    ref = spark.createDataFrame([(float(x),) for x in range(100)], "v double")
    profile = build_profile(ref, ["v"])
    own = common.stateful_session(spark, 4)
    rows = [(i, BASE + timedelta(minutes=11 * i), float(i % 50)) for i in range(400)]
    late = [(900, BASE, 1.0), (901, BASE, 2.0)]
    counted = []
    for part in (rows[:250], rows[250:] + late):
        spark.createDataFrame(part, "id bigint, ts timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(log)
        stream = common.event_stream(own, log, "*.parquet", SCHEMA, "ts")
        counted.append(write_panes(pane_counts(stream, ["v"], profile, "ts", "1 hour"), panes, state))
    assert counted[0] == 0 < counted[1] <= 2
    got = {(r["pane"], r["cell"]): r["s"] for r in read_panes(spark, panes).collect()}
    assert sum(got.values()) == 400
    whole = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, v double")
    by_hour = {r["h"]: r["count"] for r in whole.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).count().collect()}
    hours = {}
    for (pane, _), n in got.items():
        hours[pane] = hours.get(pane, 0) + n
    assert hours == by_hour


def test_append_mode_emits_each_closed_pane_once(spark, tmp_path):
    event_log(spark, str(tmp_path / "log"))
    ref = spark.createDataFrame([(float(x),) for x in range(100)], "v double")
    profile = build_profile(ref, ["v"])
    own = common.stateful_session(spark, 4)
    stream = common.event_stream(own, str(tmp_path / "log"), "*.parquet", SCHEMA, "ts", files_per_trigger=1)
    panes = pane_counts(stream, ["v"], profile, "ts", "1 hour")
    write_panes(panes, str(tmp_path / "panes"), str(tmp_path / "state"), "append")
    closed = spark.read.parquet(str(tmp_path / "panes"))
    keys = closed.select("pane", "feature", "cell")
    assert keys.count() == keys.distinct().count() > 50


def test_labels_join_their_scores_within_the_delay(spark, tmp_path):
    n = 400
    scores = [(i, BASE + timedelta(minutes=10 * i), (i % 10) / 10.0) for i in range(n)]
    labels = [(i, BASE + timedelta(minutes=10 * i, hours=(i % 5) * 10), i % 2) for i in range(n) if i % 7]
    spark.createDataFrame(scores, "id bigint, ts timestamp_ntz, score double").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame(labels, "id bigint, label_ts timestamp_ntz, label int").write.parquet(str(tmp_path / "l"))
    own = common.stateful_session(spark, 4)
    s = common.event_stream(own, str(tmp_path / "s"), "*.parquet", T.StructType.fromDDL("id bigint, ts timestamp_ntz, score double"), "ts")
    lab = common.event_stream(own, str(tmp_path / "l"), "*.parquet", T.StructType.fromDDL("id bigint, label_ts timestamp_ntz, label int"), "label_ts")
    write_labelled(labelled_predictions(s, lab, "id", "24 HOURS", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i for i in range(n) if i % 7 and (i % 5) * 10 <= 24}


def test_cooldown_over_several_micro_batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    hot, cold = sorted(rng.integers(0, 60 * 3600, 300).tolist()), sorted(rng.integers(0, 60 * 3600, 20).tolist())
    rows = [(0, i, BASE + timedelta(seconds=s)) for i, s in enumerate(hot)] + [(1, i, BASE + timedelta(seconds=s)) for i, s in enumerate(cold)]
    df = spark.createDataFrame(rows, "model bigint, id bigint, ts timestamp_ntz")
    half = F.lit(str(BASE + timedelta(hours=30))).cast("timestamp_ntz")
    df.filter(F.col("ts") < half).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    df.filter(F.col("ts") >= half).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    own = common.stateful_session(spark, 4)
    stream = common.event_stream(own, str(tmp_path / "log"), "*.parquet", T.StructType.fromDDL("model bigint, id bigint, ts timestamp_ntz"), "ts", files_per_trigger=1)
    common.run_available(cooldown_batches(stream, 60, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")))
    decided = read_decisions(spark, str(tmp_path / "out"))
    assert decided.count() == len(rows)
    for model, times in ((0, hot), (1, cold)):
        got = {int((r["ts"] - BASE).total_seconds()) for r in decided.filter((F.col("model") == model) & F.col("dispatched")).collect()}
        assert got == brute.greedy(times, 3600)


def test_each_batch_is_checked_and_kept_once(spark, tmp_path):
    from test_checks import SPEC, table

    from driftline.config import DriftConfig
    from driftline.plans.monitor import MonitorTables
    from driftline.streaming.monitor import check_each_batch

    reference = table(spark, 1500, 0)
    clean, drifted = table(spark, 600, 1), table(spark, 600, 2, 2.0, 0.4)
    later = drifted.withColumn("ts", F.col("ts") + F.expr("INTERVAL 20 DAYS"))
    source = str(tmp_path / "in")
    clean.coalesce(1).write.mode("append").parquet(source)
    later.coalesce(1).write.mode("append").parquet(source)
    own = common.stateful_session(spark, 4)
    stream = own.readStream.schema(reference.schema).option("maxFilesPerTrigger", 1).parquet(source)
    tables = MonitorTables(str(tmp_path / "out"))
    writer = check_each_batch(stream, reference, SPEC, tables, "m", 48, DriftConfig())
    common.run_available(writer.option("checkpointLocation", str(tmp_path / "state")))
    checks = spark.read.parquet(tables.checks).orderBy("batch").collect()
    assert [r["status"] for r in checks] == ["ok", "alert"]
    alerts = spark.read.parquet(f"{tables.root}/alerts").collect()
    assert len(alerts) == 1 and "*ALERT*" in alerts[0]["text"]
