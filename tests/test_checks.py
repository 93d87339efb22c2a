import os
from datetime import datetime, timedelta

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.config import DriftConfig
from driftline.operators.perturb import Shift
from driftline.plans import backtest as bt
from driftline.plans.checks import ModelSpec, build_bundle, drift_report, history, load_bundle
from driftline.session import materialise, scratch_scope, shared_root

SPEC = ModelSpec(("a", "b"), "ts", "id", 0.5, segment="seg")
BASE = datetime(2024, 1, 1)


def table(spark, n, seed, shift=0.0, flip=0.0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(shift, 1, n), rng.normal(0, 1, n)
    score = 1 / (1 + np.exp(-(a + b)))
    label = (score + rng.normal(0, 0.2, n) > 0.5).astype(int)
    label = np.where(rng.random(n) < flip, 1 - label, label)
    rows = [
        (i, BASE + timedelta(minutes=i), float(x), float(y), float(s), int(c), i % 3)
        for i, (x, y, s, c) in enumerate(zip(a, b, score, label))
    ]
    return spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, a double, b double, score double, label int, seg int")


@pytest.fixture(scope="module")
def reference(spark):
    return table(spark, 2000, 0).cache()


def test_clean_traffic_is_ok(spark, reference):
    row = drift_report(reference, table(spark, 1500, 1), SPEC).first()
    assert row["status"] == "ok" and row["drifted_features"] == [] and not row["sustained"]
    assert row["perf_f1"] > 0.7 and row["perf_drop"] < 0.05 and row["perf_roc_auc"] > 0.8
    assert row["n_samples"] == row["n_labeled"] == 1500 and row["label_coverage"] == 1.0
    assert len(row["temporal"]) == 3 and len(row["segments"]) == 3 and len(row["by_feature"]) == 2


def test_drifted_traffic_alerts(spark, reference):
    window = table(spark, 1500, 2, shift=2.0, flip=0.4)
    row = drift_report(reference, window, SPEC).first()
    assert row["status"] == "alert" and row["drifted_features"] == ["a"] and row["sustained"]
    assert row["prediction_drift_psi"] > 0.25

    def f1_of(df):
        rows = df.toPandas()
        return brute.f1(rows["label"].to_numpy(), (rows["score"].to_numpy() >= 0.5).astype(int))

    assert row["perf_f1"] == pytest.approx(f1_of(window))
    assert row["perf_drop"] == pytest.approx(f1_of(reference) - f1_of(window))
    assert row["concept_drift"] and row["perf_drop"] > 0.05


def test_concept_drift_alone_alerts_through_f1(spark, reference):
    row = drift_report(reference, table(spark, 1500, 3, flip=0.3), SPEC).first()
    assert row["status"] == "alert" and row["psi_max"] < 0.1 and row["concept_drift"]


def test_late_labels_are_masked(spark, reference):
    late = drift_report(reference, table(spark, 1500, 3, flip=0.3), SPEC, DriftConfig(label_delay_days=30)).first()
    assert late["n_labeled"] == 0 and late["perf_f1"] is None and not late["concept_drift"]
    assert late["status"] == "ok"


@pytest.mark.parametrize("n,status", [(0, "no_data"), (20, "insufficient_data")])
def test_small_windows_are_guarded(spark, reference, n, status):
    window = table(spark, 20, 4).filter(F.col("id") < n)
    row = drift_report(reference, window, SPEC).first()
    assert (row["status"], row["n_samples"], row["psi_max"], row["perf_f1"]) == (status, n, 0.0, None)


def test_backtest_tells_the_scenarios_apart(spark, reference):
    shifts = (Shift("a", offset=1.5),)
    production = table(spark, 1500, 5)
    batches = bt.scenario_batches(production, bt.SCENARIOS, (0, 1), shifts, F.col("a") > -0.5, "id", "label")
    rescored = batches.withColumn("score", 1 / (1 + F.exp(-(F.col("a") + F.col("b")))))
    rates = bt.detection_rates(bt.trials(reference, rescored, SPEC))
    got = {(r["mode"], r["intensity"]): r for r in rates.collect()}
    assert len(got) == 8 and all(r["trials"] == 2 for r in got.values())
    assert bt.false_positive_rate(rates).first()[0] == 0.0
    assert got[("covariate", 1.0)]["data_drift_detection_rate"] == 1.0
    assert got[("concept", 1.0)]["data_drift_detection_rate"] == 0.0
    assert got[("concept", 1.0)]["concept_drift_detection_rate"] == 1.0
    assert got[("both", 1.0)]["any_alert_rate"] == 1.0
    assert got[("both", 1.0)]["expected_data_drift"] and got[("both", 1.0)]["expected_concept_drift"]


def test_guarded_and_checked_reports_have_one_schema(spark, reference):
    checked = drift_report(reference, table(spark, 1500, 1), SPEC)
    guarded = drift_report(reference, table(spark, 20, 4), SPEC)
    plain = drift_report(reference, table(spark, 1500, 1), ModelSpec(("a", "b"), "ts", "id", 0.5))
    assert checked.schema.simpleString() == guarded.schema.simpleString() == plain.schema.simpleString()
    assert guarded.first()["window_start"] == BASE


def test_history_lists_missing_windows_and_unknown_models(spark, reference):
    known = reference.withColumn("model", F.lit("known"))
    log = table(spark, 300, 5).withColumn("day", F.lit(1))
    both = log.withColumn("model", F.lit("known")).unionByName(log.withColumn("model", F.lit("new")))
    small = log.filter("id < 10").withColumns({"model": F.lit("known"), "day": F.lit(2)})
    expected = spark.createDataFrame([("known", 1), ("known", 2), ("known", 3), ("new", 1)], "model string, day int")
    rows = history(known, both.unionByName(small), SPEC, "model", "day", DriftConfig(), expected).collect()
    got = {(r["model"], r["day"]): r for r in rows}
    assert {k: r["status"] for k, r in got.items()} == {
        ("known", 1): "ok", ("known", 2): "insufficient_data", ("known", 3): "no_data", ("new", 1): "no_reference"
    }
    assert got["known", 3]["n_samples"] == 0 and got["new", 1]["n_samples"] == 300
    for key in (("known", 2), ("known", 3), ("new", 1)):
        assert (got[key]["psi_max"], got[key]["perf_f1"], got[key]["drifted_features"]) == (0.0, None, [])


def scratch_files(spark):
    root = f"{shared_root(spark)}/driftline/{spark.sparkContext.applicationId}".removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_check_from_the_bundle_is_exact_and_cleans_up(spark, reference, tmp_path):
    window = table(spark, 1500, 2, shift=1.0)
    build_bundle(reference, SPEC).save(str(tmp_path / "b"))
    bundle = load_bundle(spark, str(tmp_path / "b"))
    before = scratch_files(spark)
    saved = drift_report(None, window, SPEC, bundle=bundle)
    direct = drift_report(reference, window, SPEC)
    assert scratch_files(spark) == before
    a, b = saved.first().asDict(recursive=True), direct.first().asDict(recursive=True)
    for name, value in a.items():
        if isinstance(value, float):
            assert value == pytest.approx(b[name]), name
        elif name != "by_feature":
            assert value == b[name], name
    assert [f["feature"] for f in a["by_feature"]] == [f["feature"] for f in b["by_feature"]]


def test_scopes_delete_their_own_tables_only(spark):
    df = spark.range(3)
    before = scratch_files(spark)
    with scratch_scope(spark):
        materialise(df, "outer")
        with scratch_scope(spark):
            materialise(df, "inner")
        assert [n.split("-")[0] for n in scratch_files(spark) - before] == ["outer"]
    assert scratch_files(spark) == before
