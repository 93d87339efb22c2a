"""Near-duplicate vectors against all pairs in double precision."""

import numpy as np

from driftline.llm import op11_near_embeddings as near

SCHEMA = "vec_id long, embedding array<float>, label int, k string, i int, rep long, n_links string"


def brute(rows, threshold=near.THRESHOLD):
    """vec_id -> sorted (n_links, component, kept) by the definition; rows are vectors."""
    def ok(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    vectors = [np.array(r[1], np.float32).astype(float) if ok(r) else None for r in rows]
    links = {a: set() for a in range(len(rows))}
    for a, v in enumerate(vectors):
        for b in range(a):
            w = vectors[b]
            if v is None or w is None or rows[a][2] != rows[b][2] or len(v) != len(w):
                continue
            if v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for a, r in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        least = min(ids) if ids else None
        out.append((r[0], len(links[a]), least, r[0] == least))
    return sorted(out, key=str)


def found(df, **options):
    return sorted([tuple(r) for r in near.near_vectors(df, **options).collect()], key=str)


def turned(draw, v, cosine):
    """A unit vector at the given cosine from v."""
    v = v / np.linalg.norm(v)
    w = draw.standard_normal(len(v))
    w -= (w @ v) * v
    return cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def corpus(draw, width=24):
    rows = [(k, draw.standard_normal(width).tolist(), k % 3) for k in range(150)]
    for k in range(80):  # pairs on both sides of the threshold, and other lengths of the same direction
        v = np.array(rows[k][1]) * draw.uniform(0.1, 9)
        rows.append((1000 + k, (turned(draw, v, draw.choice([0.95, 0.975, 0.983, 0.99, 1.0])) * 3).tolist(), k % 3))
    center = draw.standard_normal(width)
    rows += [(2000 + k, (center + 0.1 * draw.standard_normal(width)).tolist(), 1) for k in range(120)]
    rows += [(3000 + k, rows[5][1], 2) for k in range(60)]
    return rows


def test_against_all_pairs(spark):
    draw = np.random.default_rng(3)
    rows = corpus(draw)
    hot = rows[7][1]
    rows += [(4000, None, 1), (4001, [0.0] * 24, 1), (4002, [float("nan")] * 24, 1), (4003, [float("inf")] * 24, 1), (4004, [None] + [1.0] * 23, 1),
             (4005, hot, None), (4006, hot, None), (4007, [], 1), (4008, [1.0, 2.0], 1), (4009, [2.0, 4.0], 1), (7, hot, 1), (7, hot, 1),
             (None, hot, 1), (None, None, 1), (-5, hot, 1)]
    df = spark.createDataFrame([(*r, "x", 1, 1, "y") for r in rows], SCHEMA).repartition(4)
    want = brute(rows)
    assert found(df) == want
    # Blocks and units of any size give the same rows.
    assert found(df, block=16, unit_rows=100) == want
    assert near.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Pairs just above 0.98 meet in a key and collide often enough; random ones do not."""
    draw = np.random.default_rng(4)
    plan = near.plan_for(0.98, 100_000)
    a = near.unit_rows(draw.standard_normal((3000, 64)))
    b = np.array([turned(draw, v, 0.9801) for v in a])
    home = np.zeros(len(a), np.uint64)
    agree = near.meeting_keys(a, home, plan) == near.meeting_keys(b, home, plan)
    axes = near.axes(64, near.CHECKS, near.SEED + 2)
    half = near.WINDOW * plan.spread / 8
    count = (np.abs(a @ axes - b @ axes) <= half).sum(axis=1)
    assert (agree.any(axis=1) & (count >= plan.least)).mean() >= 0.998
    chance = near.meeting_keys(a, home, plan)[:-1] == near.meeting_keys(a, home, plan)[1:]
    assert chance.mean() < 1e-4


def test_wide_and_short_vectors(spark):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((5, 3000))
    rows = [(k, (base[k % 5] + 0.05 * draw.standard_normal(3000)).tolist(), 1) for k in range(30)]
    rows += [(100 + k, draw.standard_normal(2).tolist(), 1) for k in range(40)]
    rows += [(200 + k, [float(draw.standard_normal())], 1) for k in range(10)]
    df = spark.createDataFrame([(*r, "x", 1, 1, "y") for r in rows], SCHEMA)
    assert found(df) == brute(rows)
