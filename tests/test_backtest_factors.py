"""The factorised backtest against the one that copies the rows for every scenario."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import drift as d
from driftline.operators.perturb import Shift
from driftline.plans import backtest as bt
from driftline.plans.checks import ModelSpec

SPEC = ModelSpec(("a", "b"), "ts", "id", 0.5)
SHIFTS = (Shift("a", scale=-0.3, offset=1.5, normal_sd=0.2), Shift("b", poisson_rate=2.0, uniform_width=0.5, low=0.0, high=30.0, rounded=True))


def scored(df):
    return df.withColumn("score", F.when(F.col("a").isNotNull(), F.round(1 / (1 + F.exp(-F.col("a") + F.col("b") / 20)), 3)))


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(6)
    out = []
    for n in (800, 500):
        rows = [
            (i, None if rng.random() < 0.05 else float(rng.normal()), float(rng.poisson(8)), None if rng.random() < 0.1 else int(rng.random() < 0.4))
            for i in range(n)
        ]
        out.append(scored(spark.createDataFrame(rows, "id long, a double, b double, label int")))
    return out


def test_same_trials(sides):
    ref, prod = sides
    where, seeds = F.col("a") > -0.5, (0, 3, 4)
    batches = scored(bt.scenario_batches(prod, bt.SCENARIOS, seeds, SHIFTS, where, "id", "label"))
    keyed = lambda rows: {(r["mode"], r.intensity, r.seed): r for r in rows.collect()}
    want = keyed(bt.trials(ref, batches, SPEC))
    got = keyed(bt.factorised_trials(ref, prod, SPEC, bt.SCENARIOS, seeds, SHIFTS, where, scored))
    assert set(got) == set(want) and len(got) == len(bt.SCENARIOS) * len(seeds)
    for key, w in want.items():
        for c in ("psi_max", "pred_psi", "f1_drop"):
            assert got[key][c] == pytest.approx(w[c], abs=1e-9), (key, c)
        assert [got[key][c] for c in ("data_alert", "concept_alert", "any_alert")] == [w[c] for c in ("data_alert", "concept_alert", "any_alert")]


def test_flags_of_all_scenarios_at_once(sides):
    ref, prod = sides
    batches = bt.scenario_batches(prod, bt.COMPARISON, (1,), SHIFTS, F.col("a") > 0, "id", "label")
    found = bt.detector_comparison(ref, batches, ["a", "b"]).collect()
    assert len(found) == 2 * len(bt.COMPARISON)
    for mode, intensity in bt.COMPARISON:
        part = batches.where((F.col("mode") == mode) & (F.col("intensity") == intensity))
        one = {r.feature: r for r in d.feature_drift(ref, part, ["a", "b"]).collect()}
        for r in found:
            if r.scenario == f"{mode}@{intensity}":
                assert r.ks_flag == (one[r.feature].ks_pvalue < 0.01 and one[r.feature].ks_statistic >= 0.1)
                assert r.psi_flag == one[r.feature].drifted and r.agree == (r.psi_flag == r.ks_flag)


def test_rows_of_one_file_are_multiplied_in_many_tasks(spark, sides):
    """Production in a single partition, as a table of one row group gives it: the fan-out is shared."""
    ref, prod = sides
    tracker, group = spark.sparkContext.statusTracker(), "one-file"
    spark.sparkContext.setJobGroup(group, group)
    rows = bt.factorised_trials(ref, prod.coalesce(1), SPEC, bt.SCENARIOS, (0,), SHIFTS, F.col("a") > -0.5, scored)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
    sizes = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
    assert 4 * spark.sparkContext.defaultParallelism in sizes
    assert rows.count() == len(bt.SCENARIOS)


def test_scenarios_with_the_same_features_are_measured_once(sides):
    ref, prod = sides
    stands = bt.standing_for(bt.COMPARISON)
    measured = list(dict.fromkeys(stands.values()))
    assert len(measured) == 3 and set(stands) == set(bt.COMPARISON)
    of = lambda names: bt.scenario_batches(prod, names, (1,), SHIFTS, F.col("a") > 0, "id", "label")
    some, whole = bt.detector_comparison(ref, of(measured), ["a", "b"]), bt.detector_comparison(ref, of(bt.COMPARISON), ["a", "b"])
    assert sorted(some.collect()) == sorted(whole.collect()) and some.count() == 2 * len(bt.COMPARISON)
