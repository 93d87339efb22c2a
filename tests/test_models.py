import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import models as ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 1, 1500), rng.normal(0, 1, 1500)
    label = ((x + 0.5 * y + rng.normal(0, 0.7, 1500)) > 0.3).astype(int)
    data = [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, y, label))]
    return spark.createDataFrame(data, "id bigint, a double, b double, label int").repartition(4).cache()


@pytest.fixture(scope="module")
def trained(rows):
    return ml.train(rows, ["a", "b"], "label", "id", trees=8)


def test_split_is_exact_per_label_and_repeatable(rows):
    split = ml.stratified_split(rows, "id", "label")
    for r in split.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect():
        assert r["t"] == int(0.2 * r["n"] + 0.5)
    again = ml.stratified_split(rows.repartition(9), "id", "label")
    assert split.filter("is_test").select("id").exceptAll(again.filter("is_test").select("id")).isEmpty()
    other = ml.stratified_split(rows, "id", "label", seed=7)
    assert not split.filter("is_test").select("id").exceptAll(other.filter("is_test").select("id")).isEmpty()


def test_model_learns(trained):
    assert trained.baseline_f1 > 0.5 and trained.auc > 0.7
    assert trained.n_train + trained.n_test == 1500
    assert 0 < trained.threshold < 1


def test_saved_model_scores_the_same(spark, rows, trained, tmp_path):
    ml.save_model(spark, trained, str(tmp_path / "m"))
    loaded = ml.load_model(spark, str(tmp_path / "m"))
    assert (loaded.threshold, loaded.baseline_f1, loaded.features) == (trained.threshold, trained.baseline_f1, trained.features)
    one = ml.batch_score(rows, trained).orderBy("id").select("id", "score", "prediction").collect()
    assert one == ml.batch_score(rows, loaded).orderBy("id").select("id", "score", "prediction").collect()


def test_older_metadata_gets_defaults(spark, trained, tmp_path):
    path = str(tmp_path / "old")
    trained.pipeline.write().save(f"{path}/pipeline")
    spark.createDataFrame([(["a", "b"],)], "features array<string>").write.parquet(f"{path}/meta")
    old = ml.load_model(spark, path)
    assert (old.threshold, old.baseline_f1, old.n_train) == (0.5, 0.0, 0)


def test_unusable_rows_are_kept_unscored(spark, trained):
    df = spark.createDataFrame([(1, 0.1, 0.2), (2, float("nan"), 0.2), (3, 0.1, float("inf"))], "id int, a double, b double")
    got = {r["id"]: r for r in ml.batch_score(df, trained).collect()}
    assert got[1]["prediction"] in (0, 1) and not got[1]["quarantined"]
    assert got[2]["quarantined"] and got[3]["quarantined"] and got[2]["score"] is None and got[3]["prediction"] is None


VERSIONS = "version string, baseline_f1 double, n_heldout bigint"


def scored(spark, champion, challenger, label):
    rows = [("champion", int(a), int(c)) for a, c in zip(champion, label)]
    rows += [("challenger", int(b), int(c)) for b, c in zip(challenger, label)]
    return spark.createDataFrame(rows, "version string, prediction int, label int")


def test_promotion_rules(spark):
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 400)
    good = np.where(rng.random(400) < 0.1, 1 - label, label)
    poor = np.where(rng.random(400) < 0.4, 1 - label, label)
    both = spark.createDataFrame([("champion", 0.7, 100), ("challenger", 0.6, 90)], VERSIONS)

    better = ml.promotion_decision(scored(spark, poor, good, label), both).first()
    assert better["promoted"] and better["eval_basis"] == "production_window" and better["eval_n"] == 400
    assert better["challenger_f1"] == pytest.approx(brute.f1(label, good))
    worse = ml.promotion_decision(scored(spark, good, poor, label), both).first()
    assert not worse["promoted"] and worse["reason"] == "challenger worse than champion"
    equal = ml.promotion_decision(scored(spark, good, good, label), both).first()
    assert equal["promoted"]
    gap = brute.f1(label, good) - brute.f1(label, poor)
    assert ml.promotion_decision(scored(spark, good, poor, label), both, epsilon=gap + 1e-9).first()["promoted"]

    nothing = scored(spark, [], [], [])
    held = ml.promotion_decision(nothing, both).first()
    assert not held["promoted"] and held["eval_basis"] == "heldout" and held["eval_n"] == 90
    for versions in ([("challenger", 0.6, 90)], [("champion", 0.0, 0), ("challenger", 0.6, 90)]):
        first = ml.promotion_decision(nothing, spark.createDataFrame(versions, VERSIONS)).first()
        assert first["promoted"] and first["reason"] == "no incumbent champion" and first["champion_f1"] == 0.0


def test_a_version_that_cannot_score_is_not_promoted(spark):
    label = [1, 1, 0, 0] * 50
    rows = [("champion", c, c) for c in label]
    rows += [("challenger", None if i % 2 else c, c) for i, c in enumerate(label)]
    df = spark.createDataFrame(rows, "version string, prediction int, label int")
    versions = spark.createDataFrame([("champion", 0.7, 100), ("challenger", 0.9, 90)], VERSIONS)
    row = ml.promotion_decision(df, versions).first()
    assert not row["promoted"] and row["challenger_f1"] == pytest.approx(2 / 3) and row["eval_n"] == 200


def test_trees_learn_from_counts_of_bins(spark):
    """Rare values beside a frequent one are cut apart, and copies of all rows change no score."""
    rng = np.random.default_rng(4)
    rare = np.where(rng.random(3000) < 0.98, 0.0, rng.integers(1, 6, 3000)).astype(float)
    wide = rng.normal(0, 1, 3000)
    data = [(float(a), float(b), int(a > 2 or b > 1.5)) for a, b in zip(rare, wide)]
    df = spark.createDataFrame(data, "a double, b double, label int")
    points = ml.split_points(df, ["a", "b"])
    assert points["a"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert points["b"] == sorted(np.sort(wide)[[3000 * j // ml.BINS for j in range(1, ml.BINS)]])
    once = ml.fit_binned(df, ["a", "b"], "label", 5, 3)
    thrice = ml.fit_binned(df.union(df).union(df), ["a", "b"], "label", 5, 3)
    scores = [np.array([r.score for r in ml.probability(m.transform(df.coalesce(1))).collect()]) for m in (once, thrice)]
    assert np.allclose(scores[0], scores[1])
    truth = np.array([r[2] for r in data])
    assert scores[0][truth == 1].mean() > scores[0][truth == 0].mean() + 0.2
    assert scores[0][rare > 2].min() > scores[0][(rare == 0) & (wide < 1)].max()
