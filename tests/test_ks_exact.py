"""Exact two-sample p-values against counted lattice paths, and where the asymptotic one begins."""

from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.scalars import ks_exact, ks_method, ks_pvalue
from driftline.operators import drift as d


def paths_p(n: int, m: int, gap: Fraction) -> float:
    """The share of orders whose distribution functions come at least `gap` apart, with integers."""
    inside = lambda x, y: abs(Fraction(x, n) - Fraction(y, m)) < gap
    row = [int(inside(0, y)) for y in range(m + 1)]
    for y in range(1, m + 1):
        row[y] = row[y] if row[y - 1] else 0
    for x in range(1, n + 1):
        new = [row[0] if inside(x, 0) else 0]
        for y in range(1, m + 1):
            new.append(row[y] + new[y - 1] if inside(x, y) else 0)
        row = new
    return float(1 - Fraction(row[m], comb(n + m, n)))


def test_every_small_pair_of_sizes(spark):
    """All sizes up to 12, and every gap that two samples of these sizes can have."""
    cases = []
    for n in range(1, 13):
        for m in range(1, 13):
            gaps = {abs(Fraction(x, n) - Fraction(y, m)) for x in range(n + 1) for y in range(m + 1)}
            cases += [(n, m, float(g), paths_p(n, m, g)) for g in gaps]
    df = spark.createDataFrame(cases, "n long, m long, g double, want double").repartition(8)
    got = df.select("n", "m", "g", "want", F.expr(ks_exact("g", "n", "m")).alias("p"))
    assert got.where("abs(p - want) > 1e-12").count() == 0


@pytest.mark.parametrize("n, m", [(60, 60), (59, 47), (1, 60), (60, 7), (100, 37), (300, 200)])
def test_larger_sizes(spark, n, m):
    gaps = sorted({Fraction(k, n * m) for k in np.linspace(1, n * m, 12).astype(int)})
    cases = [(n, m, float(g), paths_p(n, m, g)) for g in map(Fraction, gaps)]
    df = spark.createDataFrame(cases, "n long, m long, g double, want double")
    for row in df.select("g", "want", F.expr(ks_exact("g", "n", "m")).alias("p")).collect():
        assert row.p == pytest.approx(row.want, rel=1e-9, abs=1e-13)


def test_small_values_keep_their_digits(spark):
    """Two samples that do not overlap: 2 of all orders, far below what 1 - x can show."""
    row = spark.range(1).select(F.expr(ks_exact("1.0D", "40L", "50L")).alias("p")).first()
    assert row.p == pytest.approx(2 / comb(90, 40), rel=1e-12)


def test_method_and_limit(spark):
    rows = [(100, 100, 0.1), (100, 101, 0.1), (0, 5, 0.0), (5, None, 0.0), (9, 9, 0.0), (2, 3, 1.0)]
    df = spark.createDataFrame(rows, "n long, m long, g double")
    named = df.withColumn("how", ks_method("g", "n", "m", exact_rows=100)).withColumn("p", ks_pvalue("g", "n", "m", "how"))
    got = {(r.n, r.m): (r.how, r.p) for r in named.collect()}
    assert [got[n, m][0] for n, m, _ in rows] == ["exact", "asymptotic", "none", "none", "exact", "exact"]
    assert got[0, 5][1] == got[5, None][1] == got[9, 9][1] == 1.0
    assert got[2, 3][1] == pytest.approx(0.2)
    assert got[100, 100][1] == pytest.approx(paths_p(100, 100, Fraction(1, 10)), rel=1e-9)


def test_samples_by_key(spark):
    draw = np.random.default_rng(1)
    rows = []
    for key, n, m in (("a", 30, 40), ("b", 200, 150), ("c", 5, 0), ("d", 0, 4)):
        rows += [(key, "ref", float(v)) for v in draw.integers(0, 20, n)] + [(key, "prod", float(v)) for v in draw.integers(3, 23, m)]
    df = spark.createDataFrame(rows, "key string, side string, v double")
    found = {r.key: r for r in d.ks_two_sample(df.where("side = 'ref'"), df.where("side = 'prod'"), ["v"], ["key"]).collect()}
    for key, n, m in (("a", 30, 40), ("b", 200, 150)):
        ref = np.array([v for k, s, v in rows if (k, s) == (key, "ref")])
        prod = np.array([v for k, s, v in rows if (k, s) == (key, "prod")])
        gap = max(abs(Fraction(int((ref <= v).sum()), n) - Fraction(int((prod <= v).sum()), m)) for v in range(25))
        assert found[key].ks_statistic == pytest.approx(float(gap)) and found[key].ks_method == "exact"
        assert found[key].ks_pvalue == pytest.approx(paths_p(n, m, gap), rel=1e-9)
    assert all(found[k].ks_method == "none" and found[k].ks_pvalue == 1.0 for k in "cd")
