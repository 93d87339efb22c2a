import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators.ordered import lay_out, neighbours, rows_at_ranks, running_totals


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_running_totals_and_ranks_over_hot_and_cold_keys(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("hot", float(v), int(n)) for v, n in zip(rng.permutation(3000), rng.integers(1, 9, 3000))]
    rows += [("cold", float(v), int(n)) for v, n in zip(rng.permutation(20), rng.integers(0, 3, 20))]
    df = spark.createDataFrame(rows, "k string, v double, n bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = lay_out(df, ["k"], ["v"], ["n"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spread = runs.rows.filter("k = 'hot'").select("_run").distinct().count()
    assert spread > 3, "a hot key is spread over several runs"
    got = {(r["k"], r["v"]): (r["n_prior"], r["n_upto"]) for r in running_totals(runs).collect()}
    for key in ("hot", "cold"):
        total = 0
        for _, v, n in sorted(r for r in rows if r[0] == key):
            assert got[(key, v)] == (total, total + n)
            total += n

    picked = rows_at_ranks(runs, "n", lambda t: F.array(F.lit(0).cast("bigint"), F.floor(t / 2), t - 1))
    flat = {key: np.repeat([v for _, v, _ in sorted(r for r in rows if r[0] == key)], [n for _, _, n in sorted(r for r in rows if r[0] == key)]) for key in ("hot", "cold")}
    for r in picked.collect():
        assert flat[r["k"]][r["rank"]] == r["v"]
    assert picked.count() == 6


def test_neighbours_in_both_directions(spark):
    rng = np.random.default_rng(5)
    answers = sorted(set(rng.integers(0, 10_000, 400).tolist()))
    probes = rng.integers(-50, 10_050, 300).tolist() + answers[:20]
    rows = [("a", x, False) for x in answers] + [("a", x, True) for x in probes] + [("b", 7, True)]
    df = spark.createDataFrame(rows, "k string, x bigint, ask boolean")
    for r in neighbours(df, ["k"], "x", "ask").filter("k = 'a'").collect():
        before = [a for a in answers if a < r["x"]]
        after = [a for a in answers if (a >= r["x"] if r["ask"] else a > r["x"])]
        assert r["previous"] == (before[-1] if before else None)
        assert r["following"] == (after[0] if after else None)
