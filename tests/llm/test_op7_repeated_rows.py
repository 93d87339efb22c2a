"""Repeated rows of a vector take no places from other ids."""

import numpy as np
import pytest

from driftline.llm import op7_nearest as ann


@pytest.mark.parametrize(("times", "ids"), [(20, [1]), (3, [1, 2, 3, 4, 5, 6])])
def test_repeated_rows_count_once(spark, times, ids):
    draw = np.random.default_rng(3)
    rows = [(100 + i, draw.standard_normal(8).tolist()) for i in range(30)]
    same = draw.standard_normal(8).tolist()
    rows += [(i, same) for i in ids for _ in range(times)] + [(7, same), (50, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann.nearest(df, lambda i: i == 50).collect()
    want = [*ids, 7][:5]
    top = sorted((r["rank"], r.vec_id) for r in got)[: len(want)]
    assert [i for _, i in top] == want
    assert all(r.score > 1 - 1e-12 for r in got if r.vec_id in want)
