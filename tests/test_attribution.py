from datetime import datetime, timedelta

import brute
import numpy as np
import pytest

from driftline.operators import attribution as a
from driftline.operators.profile import build_profile

BASE = datetime(2024, 1, 1)


def log(spark, values, segments=None, same_time=False):
    rows = [
        (i, BASE if same_time else BASE + timedelta(minutes=i), float(v), None if segments is None else segments[i])
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, x double, seg int").repartition(4)


@pytest.mark.parametrize("n,sizes", [(11, [11]), (100, [50, 50]), (152, [51, 51, 50]), (400, [134, 133, 133]), (0, [])])
def test_slices_split_like_equal_parts(spark, n, sizes):
    sliced = a.add_slice(log(spark, range(n)), "ts", "id")
    got = {r["slice"]: r["count"] for r in sliced.groupBy("slice").count().collect()}
    assert got == dict(enumerate(sizes))
    highest = -1
    for r in sliced.groupBy("slice").agg({"id": "min", "*": "count"}).orderBy("slice").collect():
        assert r["min(id)"] > highest
        highest = r["min(id)"]


def test_slices_with_one_time_for_all_rows_use_the_key(spark):
    sliced = a.add_slice(log(spark, range(300), same_time=True), "ts", "id").collect()
    assert all(r["slice"] == r["id"] // 100 for r in sliced)


def test_whole_window_shift_is_sustained_and_a_blip_is_not(spark):
    rng = np.random.default_rng(0)
    ref = rng.normal(0, 1, 3000)
    profile = build_profile(log(spark, ref), ["x"])
    everywhere = rng.normal(3, 1, 900)
    temporal = a.temporal_drift(log(spark, everywhere), ["x"], profile, "ts", "id")
    for r in temporal.collect():
        part = np.array_split(everywhere, 3)[r["slice"]]
        assert r["psi_max"] == pytest.approx(brute.numeric_psi(ref, part), abs=6e-5)
        assert r["n"] == len(part)
    assert a.sustained(temporal, 0.25).first()["sustained"]
    blip = np.concatenate([rng.normal(0, 1, 300), rng.normal(3, 1, 300), rng.normal(0, 1, 300)])
    assert not a.sustained(a.temporal_drift(log(spark, blip), ["x"], profile, "ts", "id"), 0.25).first()["sustained"]


@pytest.mark.parametrize(
    "psis,expected",
    [([0.02, 0.5, 0.02], False), ([0.5, 0.5, 0.02], True), ([0.9], False), ([0.25, 0.25], True), ([], False)],
)
def test_sustained_rule(spark, psis, expected):
    df = spark.createDataFrame([(p,) for p in psis], "psi_max double")
    assert a.sustained(df, 0.25).first()["sustained"] is expected


def test_every_segment_is_listed_and_a_hot_one_measured(spark):
    rng = np.random.default_rng(1)
    ref_seg = rng.integers(1, 9, 2000).tolist()
    ref_x = rng.normal(0, 1, 2000)
    # Segment 1 holds most rows, 2 is too small, 5 is unknown to the reference; only 8 drifts.
    prod_seg = [1] * 1500 + [2] * 10 + [3] * 60 + [4] * 60 + [5] * 60 + [6] * 60 + [7] * 60 + [8] * 60 + [None] * 5
    prod_x = rng.normal(0, 1, len(prod_seg)) + 3.0 * np.array([s == 8 for s in prod_seg])
    keep = [i for i, s in enumerate(ref_seg) if s != 5]
    ref = log(spark, ref_x[keep], [ref_seg[i] for i in keep])
    got = {r["seg"]: r for r in a.segment_drift(ref, log(spark, prod_x, prod_seg), ["x"], "seg").collect()}
    assert {s: r["status"] for s, r in got.items() if r["status"] != "checked"} == {2: "insufficient_data", 5: "no_reference"}
    assert set(got) == set(range(1, 9)) and got[2]["psi_max"] is None and got[5]["psi_max"] is None
    assert got[8]["psi_max"] >= 0.25 > max(got[s]["psi_max"] for s in (1, 3))
    first = a.segment_drift(ref, log(spark, prod_x, prod_seg), ["x"], "seg", limit=6)
    assert {r["seg"] for r in first.collect()} == set(range(1, 7))
    for s, r in got.items():
        if r["status"] != "checked":
            continue
        inside = [x for x, t in zip(prod_x, prod_seg) if t == s]
        known = [ref_x[i] for i in keep if ref_seg[i] == s]
        assert r["n"] == len(inside)
        assert r["psi_max"] == pytest.approx(brute.numeric_psi(known, inside), abs=6e-5)


def test_top_and_inspect(spark):
    table = spark.createDataFrame(
        [("a", 0.1, 0.0, False), ("b", 0.5, 0.2, True), ("c", 0.5, 0.1, True)],
        "feature string, psi double, ks_statistic double, drifted boolean",
    )
    assert [r["feature"] for r in a.top_features(table, 2).collect()] == ["b", "c"]
    assert a.inspect_feature(table, "b").first()["psi"] == 0.5
    miss = a.inspect_feature(table, "zzz").first()
    assert miss["psi"] is None and miss["available"] == "a,b,c"
