import math

import brute
import numpy as np
import pandas as pd
import pytest

from driftline.config import DriftConfig
from driftline.operators import drift as d
from driftline.operators import profile as p


def frame(spark, **columns):
    data = pd.DataFrame(columns)
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in data.itertuples(index=False)]
    kinds = {"f": "double", "i": "bigint", "O": "string"}
    schema = ", ".join(f"{c} {kinds[data[c].dtype.kind]}" for c in data.columns)
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], schema)


@pytest.fixture(scope="module")
def normal():
    rng = np.random.default_rng(0)
    gappy = rng.normal(0, 1, 2000)
    gappy[rng.random(2000) < 0.4] = np.nan
    return {
        "base": rng.normal(0, 1, 2000),
        "same": rng.normal(0, 1, 2000),
        "shifted": rng.normal(2, 1, 2000),
        "extreme": rng.normal(50, 1, 2000),
        "gappy": gappy,
    }


def test_numeric_psi_matches_brute_force_on_all_shapes(spark, normal):
    names = ["same", "shifted", "extreme", "gappy", "base"]
    ref = frame(spark, **{n: normal["base"] for n in names})
    prod = frame(spark, **{n: normal[n] for n in names})
    found = {r["feature"]: r["psi"] for r in d.numeric_psi(ref, prod, names).collect()}
    for n in names:
        assert found[n] == pytest.approx(brute.numeric_psi(normal["base"], normal[n]), abs=1e-9)
    assert found["base"] < 1e-6
    assert found["same"] < 0.1
    assert found["shifted"] > 0.5
    assert found["extreme"] < 20 and math.isfinite(found["extreme"])
    assert found["gappy"] > 0.1


def test_only_the_shifted_feature_is_flagged(spark, normal):
    rng = np.random.default_rng(1)
    ref = frame(spark, stable=normal["base"], shifted=normal["base"])
    prod = frame(spark, stable=normal["same"], shifted=rng.normal(3, 1, 2000))
    table = d.feature_drift(ref, prod, ["stable", "shifted"])
    rows = {r["feature"]: r for r in table.collect()}
    assert rows["shifted"]["drifted"] and not rows["stable"]["drifted"]
    for n in ("stable", "shifted"):
        values = prod.toPandas()[n].to_numpy()
        assert rows[n]["ks_statistic"] == pytest.approx(brute.ks(normal["base"], values), abs=1e-12)
        assert rows[n]["prod_mean"] == pytest.approx(values.mean())
        assert rows[n]["prod_std"] == pytest.approx(values.std())
    summary = d.drift_summary(table).first()
    assert summary["drifted_features"] == ["shifted"]
    assert summary["psi_max"] == rows["shifted"]["psi"]
    assert summary["ks_features_flagged"] == 1
    assert [f["feature"] for f in summary["by_feature"]] == ["shifted", "stable"]


def test_categorical_mix_shift(spark):
    ref = frame(spark, v=np.array([1] * 800 + [2] * 200))
    prod = frame(spark, v=np.array([1] * 200 + [2] * 800))
    row = d.feature_drift(ref, prod, ["v"]).first()
    assert row["is_categorical"] and row["psi"] > 0.25
    assert row["psi"] == pytest.approx(brute.value_psi([1] * 800 + [2] * 200, [1] * 200 + [2] * 800))
    same = d.categorical_psi(ref, prod, ["v"], as_text=True).first()
    assert same["psi"] == pytest.approx(row["psi"])


def test_new_production_category_counts_as_a_cell(spark):
    ref, prod = [1.0] * 50 + [2.0] * 50, [1.0] * 30 + [2.0] * 30 + [3.0] * 40
    row = d.feature_drift(frame(spark, v=np.array(ref)), frame(spark, v=np.array(prod)), ["v"]).first()
    assert row["psi"] == pytest.approx(brute.value_psi(ref, prod))
    profile = p.build_profile(frame(spark, v=np.array(ref)), ["v"])
    by_profile = d.feature_psi(frame(spark, v=np.array(prod)), ["v"], profile).first()
    assert by_profile["psi"] == pytest.approx(row["psi"])


def test_cardinality_decides_the_treatment(spark):
    data = frame(spark, n_products=np.arange(100) % 15, monthly_spend=np.arange(100) % 16)
    flags = {r["feature"]: r["is_categorical"] for r in p.categorical_features(p.to_long(data, ["n_products", "monthly_spend"])).collect()}
    assert flags == {"n_products": True, "monthly_spend": False}


def test_empty_sides_and_constant_reference(spark):
    full = frame(spark, v=np.arange(100.0))
    empty = full.filter("false")
    for a, b in ((full, empty), (empty, full)):
        row = d.feature_drift(a, b, ["v"]).first()
        assert row["psi"] == 0.0 and row["ks_statistic"] == 0.0 and row["ks_pvalue"] == 1.0
        assert d.numeric_psi(a, b, ["v"]).first()["psi"] == 0.0
    constant = frame(spark, v=np.array([5.0] * 40))
    edges = p.quantile_edges(constant, ["v"]).first()["edges"]
    assert edges == [5.0 - 1e-6, 5.0 + 1e-6]
    moved = d.numeric_psi(constant, full, ["v"]).first()["psi"]
    assert moved == pytest.approx(brute.numeric_psi([5.0] * 40, np.arange(100.0)))


def test_all_missing_reference_is_categorical_but_numeric_psi_is_zero(spark):
    ref = spark.createDataFrame([(None,)] * 20, "v double")
    prod = frame(spark, v=np.array([1.0] * 10 + [2.0] * 10))
    row = d.feature_drift(ref, prod, ["v"]).first()
    assert row["is_categorical"]
    assert row["psi"] == pytest.approx(brute.value_psi([np.nan] * 20, [1.0] * 10 + [2.0] * 10))
    assert row["missing_rate_delta"] == -1.0
    assert d.numeric_psi(ref, prod, ["v"]).first()["psi"] == 0.0


def test_nan_and_null_are_the_same(spark, normal):
    ref = frame(spark, v=normal["base"])
    nulls = frame(spark, v=normal["gappy"])
    nans = spark.createDataFrame([(float(x),) for x in normal["gappy"]], "v double")
    a, b = d.feature_drift(ref, nulls, ["v"]).first(), d.feature_drift(ref, nans, ["v"]).first()
    for c in ("psi", "ks_statistic", "prod_mean", "missing_rate_delta"):
        assert a[c] == pytest.approx(b[c], rel=1e-12)


def test_row_order_and_partitions_do_not_matter(spark, normal):
    ref, prod = frame(spark, v=normal["base"]), frame(spark, v=normal["shifted"])
    one = d.feature_drift(ref.coalesce(1), prod.coalesce(1), ["v"]).first()
    many = d.feature_drift(ref.repartition(13), prod.orderBy("v").repartition(7), ["v"]).first()
    for c in ("psi", "ks_statistic", "ref_std"):
        assert one[c] == pytest.approx(many[c], rel=1e-12)


def test_production_infinity_falls_into_the_outer_bin(spark):
    ref = frame(spark, v=np.arange(100.0))
    prod = spark.createDataFrame([(float("inf"),)] * 50 + [(float("-inf"),)] * 50, "v double")
    clipped = [99.0] * 50 + [0.0] * 50
    assert d.numeric_psi(ref, prod, ["v"]).first()["psi"] == pytest.approx(
        brute.numeric_psi(np.arange(100.0), clipped)
    )


def test_ks_with_one_value_holding_a_third_of_the_rows(spark):
    rng = np.random.default_rng(3)
    ref = np.concatenate([np.zeros(500), rng.normal(0, 1, 1000)])
    prod = np.concatenate([np.zeros(500), rng.normal(0.2, 1, 1000)])
    row = d.ks_two_sample(frame(spark, v=ref), frame(spark, v=prod), ["v"]).first()
    assert row["ks_statistic"] == pytest.approx(brute.ks(ref, prod), abs=1e-12)


def test_score_psi_is_never_categorical(spark):
    rng = np.random.default_rng(4)
    low, low2, high = rng.beta(2, 5, 3000), rng.beta(2, 5, 3000), rng.beta(5, 2, 3000)
    ref = frame(spark, score=low)
    assert d.prediction_psi(ref, frame(spark, score=low2)).first()[0] < 0.05
    assert d.prediction_psi(ref, frame(spark, score=high)).first()[0] > 0.5
    few = frame(spark, score=np.array([0.2, 0.4, 0.6] * 30))
    assert d.prediction_psi(few, few).first()[0] < 1e-6


def test_profile_can_be_saved_and_used_again(spark, normal, tmp_path):
    ref, prod = frame(spark, v=normal["base"]), frame(spark, v=normal["gappy"])
    profile = p.build_profile(ref, ["v"])
    profile.save(str(tmp_path / "profile"))
    loaded = p.load_profile(spark, str(tmp_path / "profile"), max_rows=1)
    assert d.feature_psi(prod, ["v"], loaded).first()["psi"] == pytest.approx(
        brute.numeric_psi(normal["base"], normal["gappy"])
    )


def test_sketch_profile_is_close_to_the_exact_one(spark, normal):
    ref = frame(spark, v=normal["base"], c=np.arange(2000) % 5)
    prod = frame(spark, v=normal["shifted"], c=np.arange(2000) % 4)
    exact = {r["feature"]: r["psi"] for r in d.feature_psi(prod, ["v", "c"], p.build_profile(ref, ["v", "c"])).collect()}
    rough = {r["feature"]: r["psi"] for r in d.feature_psi(prod, ["v", "c"], p.approximate_profile(ref, ["v", "c"])).collect()}
    assert rough["c"] == pytest.approx(exact["c"], abs=1e-12)
    assert rough["v"] == pytest.approx(exact["v"], rel=0.02)


def test_alert_threshold_is_inclusive(spark):
    ref = frame(spark, v=np.array([1] * 800 + [2] * 200))
    prod = frame(spark, v=np.array([1] * 200 + [2] * 800))
    psi = d.feature_drift(ref, prod, ["v"]).first()["psi"]
    assert d.feature_drift(ref, prod, ["v"], DriftConfig(psi_alert=psi)).first()["drifted"]


def test_fingerprint_tells_nulls_copies_and_separators_apart(spark):
    from driftline.operators.profile import dataset_fingerprint

    def of(rows):
        df = spark.createDataFrame(rows, "a string, b string, c string").repartition(3)
        return tuple(dataset_fingerprint(df, ["a", "b", "c"]).first())

    tables = [
        [("1", None, "2")], [("1", "2", None)], [("1", "", "2")], [("1~", "2", "")], [("1", "~2", "")],
        [("1", None, "2")] * 2, [("1", "2", None)] * 2, [("x", "y", "z")] * 2, [("x", "y", "z"), ("1", "2", "3")],
    ]
    found = [of(t) for t in tables]
    assert len(set(found)) == len(tables)
    assert of(tables[-1][::-1]) == found[-1]
    assert of(tables[0][:0]) == (0, 0, 0)


def test_a_group_that_is_new_in_production_is_listed(spark):
    from driftline.operators.drift import feature_drift as table

    ref = spark.createDataFrame([(s, float(i)) for s in (0, 1, 3) for i in range(200)], "seg int, x double")
    prod = spark.createDataFrame([(s, float(i)) for s in (0, 1, 2) for i in range(200)], "seg int, x double")
    got = {r["seg"]: (r["status"], r["psi"]) for r in table(ref, prod, ["x"], keys=["seg"]).collect()}
    assert {s: v[0] for s, v in got.items()} == {0: "compared", 1: "compared", 2: "no_reference", 3: "no_production"}
    assert got[2][1] is None and got[0][1] == 0.0
