"""Sketch statistics against the exact ones, within the errors they state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import drift as d
from driftline.operators import sketches as sk

CASES = {
    "same": (lambda r: r.normal(0, 1, 20_000), lambda r: r.normal(0, 1, 15_000)),
    "shifted": (lambda r: r.normal(0, 1, 20_000), lambda r: r.normal(0.4, 1.3, 5_000)),
    "ties": (lambda r: r.poisson(12, 30_000), lambda r: r.poisson(14, 9_000)),
    "atom": (lambda r: np.where(r.random(20_000) < 0.4, 3.0, r.exponential(5, 20_000)), lambda r: np.where(r.random(9_000) < 0.3, 3.0, r.exponential(6, 9_000))),
    "outside": (lambda r: r.random(6_000), lambda r: r.random(6_000) * 3 - 1),
    "small": (lambda r: r.normal(0, 1, 150), lambda r: r.normal(1, 1, 120)),
    "apart": (lambda r: r.random(5_000), lambda r: r.random(3_000) + 50),
}


def frames(spark, rng):
    names, sides = list(CASES), []
    for which in (0, 1):
        draws = {n: CASES[n][which](rng) for n in names}
        size = max(map(len, draws.values()))
        columns = [[float(v) for v in draws[n]] + [None] * (size - len(draws[n])) for n in names]
        columns.append([float(i % (4 + which)) for i in range(size)])
        rows = list(zip(range(size), *columns, strict=True))
        schema = "i long, " + ", ".join(f"{n} double" for n in [*names, "code"])
        sides.append(spark.createDataFrame(rows, schema).withColumn("ts", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(i % 7 as int))")))
    return names + ["code"], sides


@pytest.fixture(scope="module")
def compared(spark, tmp_path_factory):
    names, (ref, prod) = frames(spark, np.random.default_rng(5))
    exact = {r.feature: r for r in d.feature_drift(ref, prod, names).collect()}
    path = str(tmp_path_factory.mktemp("sketches"))
    categorical = sk.categorical_names(sk.sketch(ref, names, quarantine=True))
    sides = []
    for side, df in (("ref", ref), ("prod", prod)):
        for _ in range(2):  # stored twice: a date replaces itself
            sk.store_dates(df, names, "ts", f"{path}/{side}", categorical, quarantine=side == "ref")
        sides.append(sk.load_dates(spark, f"{path}/{side}", "2024-01-01", "2024-01-07"))
    (a, av), (b, bv) = sides
    table = sk.sketch_drift(a, b, av, bv, categorical)
    return exact, {r.feature: r for r in table.collect()}, (ref, prod, path, names)


def test_stated_errors_hold(compared):
    exact, found, _ = compared
    assert set(exact) == set(found)
    for name, e in exact.items():
        f = found[name]
        assert f.psi_low - 1e-9 <= e.psi <= f.psi_high + 1e-9, name
        assert f.psi_low - 1e-9 <= f.psi <= f.psi_high + 1e-9, name
        assert abs(f.ks_statistic - e.ks_statistic) <= (f.ks_error if not f.is_categorical else 0.01) + 1e-9, name
        assert f.ks_error <= 0.004
        for c in ("ref_mean", "prod_mean", "ref_std", "prod_std", "missing_rate_delta"):
            assert f[c] == pytest.approx(e[c], rel=1e-9, abs=1e-12), (name, c)
        assert f.is_categorical == e.is_categorical and (not f.is_categorical or f.psi == pytest.approx(e.psi))
    # The bounds are of use: narrow beside what they bound.
    assert all(found[n].psi_high - found[n].psi_low < 0.25 * found[n].psi + 0.05 for n in ("same", "shifted", "outside"))


def test_a_span_of_dates(spark, compared):
    _, _, (ref, prod, path, names) = compared
    some, values = sk.load_dates(spark, f"{path}/prod", "2024-01-03", "2024-01-04")
    direct = sk.sketch(prod.where("ts >= '2024-01-03' and ts < '2024-01-05'"), names)
    want = {r.feature: r for r in direct.collect()}
    for r in some.collect():
        assert (r.n_rows, r.n_present, r.low, r.high) == (want[r.feature].n_rows, want[r.feature].n_present, want[r.feature].low, want[r.feature].high)
        assert r["mean"] == pytest.approx(want[r.feature]["mean"]) and r.squares == pytest.approx(want[r.feature].squares or 0.0)
    assert values.agg(F.sum("n")).first()[0] == want["code"].n_rows


def test_no_reading_is_shuffled(spark, compared):
    """Every exchange of the plan lies above an aggregation into sketches or values of categories."""
    _, _, (ref, prod, _, names) = compared
    plan = sk.sketch(prod, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "kll_sketch_agg_double" in plan and "value#" not in plan.split("Aggregate")[1].split("]")[0]


def test_empty_and_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    empty = sk.merge(sk.sketch(df, ["a", "b"]))
    found = {r.feature: r for r in sk.sketch_drift(empty, empty, sk.value_table(df, ["a"]), sk.value_table(df, ["a"]), []).collect()}
    assert found["a"].psi == 0.0 and found["a"].ks_method == "none" and found["a"].ks_pvalue == 1.0
    assert found["b"].psi == pytest.approx(0.0)
    assert sk.sketch(df.limit(0), ["a"]).count() == 0


def test_sketches_by_key(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(v)) for k, shift in (("x", 0.0), ("y", 2.0)) for v in rng.normal(shift, 1, 3000)]
    prod = spark.createDataFrame(rows, "key string, v double")
    ref = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 4000)], "v double")
    table = sk.sketch_drift(sk.sketch(ref, ["v"]), sk.sketch(prod, ["v"], ["key"]), sk.value_table(ref, []), sk.value_table(prod, [], ["key"]), [], keys=["key"])
    found = {r.key: r for r in table.collect()}
    for key in "xy":
        exact = d.feature_drift(ref, prod.where(F.col("key") == key), ["v"]).first()
        assert found[key].psi_low <= exact.psi <= found[key].psi_high
        assert found[key].drifted == (key == "y")


def test_interpolated_edges_of_whole_numbers(spark):
    """Edges between two whole numbers, and readings that the sketch holds all: the bounds hold the exact PSI."""
    rng = np.random.default_rng(3)
    ref = spark.createDataFrame([(float(v),) for v in rng.integers(0, 30, 698)], "v double")
    prod = spark.createDataFrame([(float(v),) for v in rng.integers(0, 30, 333)], "v double")
    found = sk.sketch_drift(sk.sketch(ref, ["v"]), sk.sketch(prod, ["v"]), sk.value_table(ref, []), sk.value_table(prod, []), []).first()
    exact = d.feature_drift(ref, prod, ["v"]).first()
    assert found.psi_low - 1e-9 <= exact.psi <= found.psi_high + 1e-9
    assert found.psi == pytest.approx(exact.psi, abs=0.01) and found.psi_high - found.psi_low < 0.05


def test_rank_error_is_the_published_one():
    """A sketch of size 200 is stated with 1.65 % for shares of an interval and 1.33 % for a rank."""
    assert sk.rank_error(200) == pytest.approx(0.0165, abs=1e-4)
    assert sk.rank_error(sk.SKETCH_SIZE) < 0.001
