from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_checks import SPEC, table

from driftline.config import DriftConfig
from driftline.operators.history import recent, resolve_champions
from driftline.plans.checks import load_bundle
from driftline.plans.monitor import (
    MonitorTables,
    evaluate_and_promote,
    performance_view,
    record_verdicts,
    report_list,
    request_retrain,
    run_check,
    train_and_persist,
)
from driftline.sources import sinks

NOW = datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def reference(spark):
    return table(spark, 2000, 0).cache()


def test_checks_are_persisted_and_listed_newest_first(spark, reference, tmp_path):
    tables = MonitorTables(str(tmp_path))
    _, quiet = run_check(reference, table(spark, 1500, 1), SPEC, tables, "m", NOW, hours=24)
    _, alert = run_check(reference, table(spark, 1500, 2, 2.0, 0.4), SPEC, tables, "m", NOW + timedelta(hours=1))
    for _ in range(2):  # a retry leaves one record
        run_check(reference, table(spark, 20, 3), SPEC, tables, "m", NOW + timedelta(hours=2))
    assert quiet.isEmpty() and "*ALERT*" in alert.first()["text"]
    stored = spark.read.parquet(tables.checks)
    assert [r["status"] for r in recent(stored, "ts").collect()] == ["insufficient_data", "alert", "ok"]
    runs = {r["run_id"]: r for r in spark.read.parquet(tables.runs).collect()}
    assert len(runs) == 3
    guarded = runs[f"m|{NOW + timedelta(hours=2)}"]
    assert "perf_f1" not in guarded["metrics"] and guarded["tags"]["drift_status"] == "insufficient_data"

    said = '{"diagnosis": "moved", "recommendations": [], "trigger_retraining": true}'
    ids = [r["id"] for r in recent(stored, "ts").collect()]
    texts = spark.createDataFrame([(ids[1], f"so {said}"), (ids[2], "nothing")], "id string, text string")
    assert record_verdicts(texts, "id", "text", tables).count() == 1
    listed = {r["id"]: r["diagnosis"] for r in report_list(spark, tables).collect()}
    assert listed == {ids[0]: None, ids[1]: "moved", ids[2]: None}
    shown = performance_view(stored).collect()
    assert [r["n_samples"] for r in shown] == [20, 1441, 1441] and shown[1]["concept_drift"] and shown[0]["perf_f1"] is None
    sinks.export_json(performance_view(stored), str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export")).count() == 3


def test_requests_are_gated_and_audited(spark, tmp_path):
    tables = MonitorTables(str(tmp_path))
    report = spark.createDataFrame([("m", 0.4, 0.12)], "model string, psi_max double, perf_drop double")

    def ask(minutes, config=None, **extra):
        try:
            audits = spark.read.parquet(tables.audits)
        except Exception:
            audits = None
        return request_retrain(report, "x | sh", audits, tables, NOW + timedelta(minutes=minutes), config, **extra).first()

    assert ask(0, DriftConfig(retrain_enabled=False))["decision"] == "blocked"
    assert ask(1, configured=False)["decision"] == "skipped"
    assert ask(2, DriftConfig(retrain_dry_run=True))["decision"] == "dry_run"
    limited = ask(30)
    assert limited["decision"] == "blocked" and "28.0m ago" in limited["detail"] and not limited["allowed"]
    assert ask(62)["decision"] == "dispatched"
    assert ask(63)["decision"] == "blocked"
    stored = spark.read.parquet(tables.audits)
    assert stored.count() == 6 and stored.filter("reason <> 'drift thresholds breached'").isEmpty()


def test_promotion_run(spark, reference, tmp_path):
    tables = MonitorTables(str(tmp_path))
    log = table(spark, 800, 4)
    columns = (["a", "b"], "label", "id", "ts", tables, "churn")
    first = evaluate_and_promote(spark, reference, log, *columns, 1, trees=3).first()
    assert first["promoted"] and first["reason"] == "no incumbent champion"
    champion = f"{tables.root}/models/churn/v=1"
    broken = reference.withColumn("label", 1 - F.col("label"))
    second = evaluate_and_promote(spark, broken, log, *columns, 2, champion_path=champion, trees=3).first()
    assert not second["promoted"] and second["eval_basis"] == "production_window" and second["eval_n"] == 800
    registry = spark.read.parquet(tables.registry)
    assert resolve_champions(registry).first()["uri"] == "models:/churn@champion (v1)"


def test_train_and_persist_keeps_all_that_a_check_needs(spark, reference, tmp_path):
    tables = MonitorTables(str(tmp_path))
    model = train_and_persist(spark, reference, ["a", "b"], "label", "id", tables, "churn", 1, segment="seg", trees=3)
    bundle = load_bundle(spark, f"{tables.root}/models/churn/v=1/reference")
    assert bundle.baseline[1] == 2000 and bundle.segments.features.select("seg").distinct().count() == 3
    run = spark.read.parquet(tables.runs).first()
    assert run["metrics"]["f1"] == model.baseline_f1 and run["tags"]["kind"] == "train"
    assert resolve_champions(spark.read.parquet(tables.registry)).first()["uri"] == "models:/churn@champion (v1)"
    report, _ = run_check(None, table(spark, 1500, 1), SPEC, tables, "churn", NOW, bundle=bundle)
    assert report.first()["n_ref_rows"] == 2000 and report.first()["n_samples"] == 1441
