from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import quality
from driftline.operators.history import resolve_champions
from driftline.session import materialise, scratch_path, shared_root
from driftline.sources import sinks
from driftline.sources.tables import empty_log, legacy_union_window, lookback_window

LOG = "SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts FROM range(100)"


def test_lookback_is_inclusive_and_pushed_to_the_scan(spark, tmp_path):
    spark.sql(LOG).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    window = lookback_window(log, "ts", 24)
    assert sorted(r["id"] for r in window.collect()) == list(range(75, 100))
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_lookback_on_a_partitioned_log_prunes_dates(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(spark.sql(LOG).filter("id < 60"), path, "ts")
    sinks.append_log(spark.sql(LOG).filter("id >= 60"), path, "ts")
    log = sinks.read_log(spark, path)
    assert log.count() == 100
    window = lookback_window(log, "ts", 24, partition="event_date")
    assert sorted(r["id"] for r in window.collect()) == list(range(75, 100))
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_append_adds_rows_and_keeps_the_old_ones(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(spark.sql(LOG).limit(20), path, "ts")
    sinks.append_log(spark.sql(LOG).limit(30), path, "ts")
    assert sinks.read_log(spark, path).count() == 50


def test_legacy_union_takes_the_newest_time_of_both(spark):
    parts = spark.sql(LOG).withColumn("extra", F.lit(1))
    newer = spark.sql("SELECT -1L AS id, timestamp_ntz'2024-01-06 00:00:00' AS ts")
    window = legacy_union_window(newer, parts, "ts", 24)
    assert sorted((r["id"], r["extra"]) for r in window.collect()) == [(-1, None), (96, 1), (97, 1), (98, 1), (99, 1)]
    assert legacy_union_window(None, parts, "ts", 24).count() == 25
    dated = parts.withColumn("day", F.to_date("ts"))
    assert legacy_union_window(newer, dated, "ts", 24, "day").drop("day").exceptAll(window).isEmpty()


def test_empty_log_keeps_its_columns(spark):
    schema = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("x", T.DoubleType())])
    empty = lookback_window(empty_log(spark, schema), "ts", 24)
    assert empty.columns == ["ts", "x"] and empty.isEmpty()


def test_column_checks(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b double, a double")
    assert quality.require_columns(df, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match="missing features: \\['c'\\]"):
        quality.require_columns(df, ["a", "b", "c"])
    with pytest.raises(ValueError, match="unknown features: \\['b'\\]"):
        quality.require_columns(df, ["a"])


def test_quarantine_names_the_bad_features(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (1.0, float("-inf")), (None, float("inf"))], "a double, b double")
    got = [r["bad_features"] for r in quality.quarantine(df, ["a", "b"]).collect()]
    assert got == [[], ["a"], ["b"], ["a", "b"]]


def test_check_rows_have_defaults_and_json(spark):
    reports = spark.createDataFrame(
        [("m", datetime(2024, 1, 1), None, None, None, None, None, None, None, ["x"])],
        "model string, ts timestamp, status string, psi_max double, psi_mean double, perf_f1 double, perf_drop double, "
        "window_start timestamp, window_end timestamp, drifted_features array<string>",
    )
    row = sinks.drift_check_rows(reports, ["model", "ts"]).first()
    assert (row["status"], row["psi_max"], row["psi_mean"], row["perf_f1"]) == ("ok", 0.0, 0.0, None)
    assert '"drifted_features":["x"]' in row["report"] and row["id"] == "m|2024-01-01 00:00:00"


def test_run_rows_drop_missing_metrics(spark):
    df = spark.createDataFrame([("r", 1.0, None, "ok", None)], "id string, a double, b double, status string, end string")
    row = sinks.run_rows(df, F.col("id"), ["a", "b"], ["status", "end"]).first()
    assert row["metrics"] == {"a": 1.0} and row["tags"] == {"status": "ok", "end": ""}


def test_reference_versions_and_champion(spark, tmp_path):
    df = spark.range(5)
    first = sinks.save_reference(df, str(tmp_path / "reference"), 1)
    second = sinks.save_reference(df, str(tmp_path / "reference"), 2)
    registry = str(tmp_path / "registry")
    sinks.register_version(spark, registry, "churn", 9, "champion", first)
    sinks.register_version(spark, registry, "churn", 10, None, second)
    sinks.register_version(spark, registry, "other", 9, None, first)
    sinks.register_version(spark, registry, "other", 10, None, second)
    got = {r["model"]: r["uri"] for r in resolve_champions(spark.read.parquet(registry)).collect()}
    assert got == {"churn": "models:/churn@champion (v9)", "other": "models:/other/10"}
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save_reference(df, str(tmp_path / "reference"), 1)


def test_scratch_lies_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_root(spark))
    assert materialise(spark.range(3), "x").count() == 3
