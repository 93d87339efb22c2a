import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.config import DriftConfig
from driftline.operators import performance as m


@pytest.fixture(scope="module")
def signal():
    rng = np.random.default_rng(0)
    x = rng.random(2000)
    label = (x > 0.5).astype(int)
    noisy = np.where(rng.random(2000) < 0.3, 1 - label, label)
    return x.round(2), label, noisy


def scored(spark, score, label):
    return spark.createDataFrame(list(zip(score.tolist(), label.tolist())), "score double, label int")


def test_perfect_and_noisy_labels(spark, signal):
    x, label, noisy = signal
    sharp = np.clip((x > 0.5).astype(float), 0.01, 0.99)
    truth = np.where(x > 0.5, 1, 0)
    perfect = m.f1_at_threshold(scored(spark, sharp, truth), 0.5)
    assert perfect.first()["f1"] == 1.0
    counts = m.confusion_counts(scored(spark, sharp, noisy), 0.5)
    row = m.performance_vs_baseline(counts, F.lit(1.0)).first()
    assert row["perf_f1"] == pytest.approx(brute.f1(noisy, (sharp >= 0.5).astype(int)))
    assert row["concept_drift"] and row["perf_drop"] == pytest.approx(1.0 - row["perf_f1"])


def test_no_labels_or_no_baseline_is_neutral(spark, signal):
    x, _, noisy = signal
    df = scored(spark, x, noisy)
    blank = df.withColumn("label", F.lit(None).cast("int"))
    row = m.performance_vs_baseline(m.confusion_counts(blank, 0.5), F.lit(0.9)).first()
    assert row["perf_f1"] is None and row["perf_drop"] == 0.0 and not row["concept_drift"]
    assert row["n_samples"] == 2000 and row["n_labeled"] == 0 and row["label_coverage"] == 0.0
    row = m.performance_vs_baseline(m.confusion_counts(df, 0.5), F.lit(0.0)).first()
    assert row["perf_drop"] == 0.0 and not row["concept_drift"]


def test_auc_with_ties_and_single_class(spark, signal):
    x, label, noisy = signal
    assert m.roc_auc(scored(spark, x, noisy)).first()["roc_auc"] == pytest.approx(brute.auc(noisy, x))
    assert m.roc_auc(scored(spark, x, np.ones(2000, int))).first()["roc_auc"] == 0.0


def test_curve_and_tuned_threshold(spark, signal):
    x, _, noisy = signal
    df = scored(spark, x, noisy)
    expected = {t: brute.f1(noisy, (x >= t).astype(int)) for t in np.unique(x)}
    curve = {r["threshold"]: r for r in m.pr_curve(df).collect()}
    assert set(curve) == set(expected)
    for t, row in curve.items():
        assert row["f1"] == pytest.approx(expected[t])
        assert row["recall"] == pytest.approx(((x >= t) & (noisy == 1)).sum() / (noisy == 1).sum())
    best = m.tune_threshold(df).first()
    top = max(expected.values())
    assert best["f1"] == pytest.approx(top)
    assert best["threshold"] == min(t for t, f in expected.items() if f == top)


def test_threshold_ties_take_the_lowest_and_none_gives_the_default(spark):
    tie = scored(spark, np.array([0.2, 0.4, 0.6, 0.8]), np.array([1, 0, 0, 0]))
    assert m.tune_threshold(tie).first()["threshold"] == 0.2
    assert m.tune_threshold(tie.filter("false")).first()["threshold"] == 0.5


def test_label_delay_masks_late_rows(spark):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id) AS ts FROM range(10)")
    end = df.agg(F.max("ts")).first()[0]
    assert m.label_slice(df, "ts", end, 0).count() == 10
    assert m.label_slice(df, "ts", end, 3).count() == 7
    assert m.label_slice(df, "ts", end, 30).count() == 0
    assert DriftConfig(label_delay_days=30).label_delay_days == 30


def test_rows_without_a_score_are_not_labelled_rows(spark):
    rows = [(0.9, 1), (0.1, 0), (None, 1), (None, 1), (None, 0), (0.8, None)]
    row = m.f1_at_threshold(spark.createDataFrame(rows, "score double, label int"), 0.5).first()
    assert (row["n_samples"], row["n_labeled"], row["n_unscored"]) == (6, 2, 3)
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == row["n_labeled"]
