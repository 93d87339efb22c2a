import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import perturb as x
from driftline.operators.drift import feature_drift


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(0)
    rows = [
        (i, float(rng.normal(300, 80)), float(rng.uniform(0.01, 0.99)), float(rng.integers(0, 40)), float(rng.integers(0, 5)), int(rng.random() < 0.4))
        for i in range(3000)
    ]
    names = "id bigint, monthly_spend double, credit_utilisation double, logins_last_30d double, support_tickets double, churned int"
    return spark.createDataFrame(rows, names).repartition(5)


FEATURES = ["monthly_spend", "credit_utilisation", "logins_last_30d", "support_tickets"]
DISCRETE = ["logins_last_30d", "support_tickets"]


def batch(pool, mode, intensity=1.0, seed=1, n=2000):
    """Draws with noise, then the shift and the flip that the mode asks for."""
    labels = pool.select(F.col("id").alias("source_id"), "churned")
    rows = x.bootstrap_jitter(pool, n, "id", FEATURES, DISCRETE, seed).join(labels, "source_id")
    if mode in ("covariate", "both"):
        rows = x.inject_covariate_shift(rows, x.PUBLISHED_SHIFTS, intensity, ["draw_id"], seed)
    if mode in ("concept", "both"):
        rows = x.inject_label_flip(rows, "churned", F.col("credit_utilisation") > 0.5, intensity, ["draw_id"], seed)
    return rows


def psi_max(pool, rows):
    return feature_drift(pool, rows, FEATURES).agg(F.max("psi")).first()[0]


def test_clean_batch_is_close_and_covariate_batch_is_not(pool):
    assert psi_max(pool, batch(pool, "none")) < 0.1
    assert psi_max(pool, batch(pool, "covariate")) >= 0.25


def test_concept_mode_moves_labels_and_not_features(pool):
    clean = batch(pool, "none").select("draw_id", "churned", *FEATURES)
    flipped = batch(pool, "concept").select("draw_id", F.col("churned").alias("c2"), *[F.col(f).alias(f + "2") for f in FEATURES])
    both = clean.join(flipped, "draw_id")
    assert both.filter("churned <> c2").count() / both.count() > 0.05
    for f in FEATURES:
        assert both.filter(F.col(f) != F.col(f + "2")).isEmpty()


def test_same_seed_same_rows_whatever_the_partitioning(pool):
    one = batch(pool, "both", seed=3).orderBy("draw_id").collect()
    two = batch(pool.repartition(11), "both", seed=3).orderBy("draw_id").collect()
    assert one == two
    assert one != batch(pool, "both", seed=4).orderBy("draw_id").collect()


def test_shapes_of_the_batch(pool):
    rows = batch(pool, "both", n=500)
    assert rows.count() == 500
    facts = rows.agg(
        F.min("credit_utilisation"), F.max("credit_utilisation"),
        F.max("support_tickets"), F.sum((F.col("logins_last_30d") % 1 != 0).cast("int")),
    ).first()
    assert 0.01 <= facts[0] and facts[1] <= 0.99 and facts[2] <= 20 and facts[3] == 0


def test_noise_has_the_right_moments(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    row = df.select(
        x.normal_noise(["k"], 1, "a").alias("z"), x.poisson_noise(["k"], 1, "b", F.lit(1.5), 1.5).alias("p")
    ).agg(F.avg("z"), F.stddev("z"), F.avg("p"), F.variance("p")).first()
    assert row[0] == pytest.approx(0, abs=0.03) and row[1] == pytest.approx(1, abs=0.03)
    assert row[2] == pytest.approx(1.5, abs=0.05) and row[3] == pytest.approx(1.5, abs=0.1)


def test_without_a_label_nothing_flips(pool):
    bare = pool.drop("churned")
    assert x.inject_label_flip(bare, "churned", F.lit(True), 1.0, ["id"], 1) is bare


def test_large_poisson_rates_are_not_cut(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    row = df.select(x.poisson_noise(["k"], 1, "b", F.lit(50.0), 50.0).alias("p")).agg(F.avg("p"), F.variance("p"), F.max("p")).first()
    assert row[0] == pytest.approx(50, abs=0.3) and row[1] == pytest.approx(50, rel=0.05) and row[2] > 70
