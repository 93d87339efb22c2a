"""Nearest neighbours against brute force."""

import numpy as np

from driftline.llm import op7_nearest as ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, every, k=5):
    """Exact answer over usable rows, by the definition."""
    usable = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable.append((i, np.array(v, np.float32).astype(float)))
    out = {}
    for q, a in usable:
        if q % every:
            continue
        best = {}
        for i, b in usable:
            if i != q and len(a) == len(b):
                score = float(np.einsum("i,i->", a, b) / np.sqrt(np.einsum("i,i->", a, a)) / np.sqrt(np.einsum("i,i->", b, b)))
                best[i] = max(score, best.get(i, -9))
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_edges(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.standard_normal(8).round(2).tolist(), "x") for i in range(60)]
    hot = draw.standard_normal(8).round(2).tolist()
    rows += [(100 + i, hot, "y") for i in range(40)]
    rows += [(200, None, ""), (210, [0.0] * 8, ""), (220, [float("nan")] * 8, ""), (230, [None] + [1.0] * 7, ""), (240, [float("inf")] * 8, "")]
    rows += [(None, hot, ""), (300, [1.0, 2.0], ""), (310, [2.0, 1.0], ""), (20, rows[20][1], ""), (250, [], ""), (-10, hot, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got, want = found(ann.nearest(df, lambda i: i % 10 == 0, block=16, query_block=4)), brute(rows, 10)
    want = {q: v for q, v in want.items() if v}
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)
    assert ann.nearest(df.limit(0), lambda i: i % 10 == 0).count() == 0


def test_recall_and_pruning():
    draw = np.random.default_rng(2)
    centers = draw.standard_normal((50, 32))
    vectors = centers[draw.integers(0, 50, 5000)] + 0.3 * draw.standard_normal((5000, 32))
    index = ann.Index(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = verified = 0
    for q in range(0, 5000, 100):
        places, cosines = index.search(vectors[q], 6, np.ones(5000))
        near = set(places[np.argsort(-cosines)][:6].tolist())
        hits += len(near & set(np.argsort(-(unit @ unit[q]))[:6].tolist()))
        verified += len(places)
    assert hits >= 0.9 * 6 * 50
    assert verified < 0.3 * 5000 * 50


def test_recall_on_the_supplied_vectors(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, want = found(ann.op7_nearest(spark, folder)), brute(rows, ann.EVERY)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
