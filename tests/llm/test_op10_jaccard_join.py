"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from driftline.llm import op10_jaccard_join as jj
from driftline.llm.graph import components

SCHEMA = "doc_id long, text string, n long, member string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words]
    if not words:
        return frozenset()
    if len(words) < 3:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))


def plain(rows):
    sets = [shingles(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        own = r[0] if not sets[i] else min(ids, default=None)
        out.append((r[0], len(sets[i]), own, links[i]))
    return sorted(out, key=str)


def corpus(seed, families=14, size=9):
    """Families whose members lie on both sides of the threshold, of all lengths."""
    draw = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([1, 2, 3, 5, 11, 12, 13, 20, 40, 90, 200, 600]))]
        for _ in range(size):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, len(base) // 50, len(base) // 30])):
                words[draw.randrange(len(words))] = f"x{draw.randint(0, 10**6)}"
            if draw.random() < 0.3:
                words = words[: max(1, int(len(words) * draw.choice([0.9, 0.95, 0.99])))]
            rows.append((len(rows) * 7 % 1009, " ".join(w.upper() if draw.random() < 0.2 else w for w in words), 1, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [4 << 20, 60])
def test_components(spark, seed, block):
    rows = corpus(seed)
    got = jj.component_table(spark.createDataFrame(rows, SCHEMA).repartition(6), block_shingles=block)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_edges(spark):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(3, text), (1, text.upper()), (1, text), (None, text + " z"), (None, "alone here now"), (5, None), (6, ""), (7, " \n"), (5, "ab"), (8, "AB"),
            (9, "É é x"), (10, "é é x"), (11, "a\x85b c\x1fd"), (12, " ".join(["the"] * 50_000))]
    rows = [(i, t, 0, "") for i, t in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, jj.component_table(df).collect()), key=str) == plain(rows)
    assert jj.component_table(df.limit(0)).count() == 0
    kept = jj.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text[:4] if r.text else r.text) for r in kept.where("doc_id is not null").collect() if r.doc_id != 5) == [
        (1, "V0 V"), (6, ""), (7, " \n"), (9, "É é "), (10, "é é "), (11, "a\x85b "), (12, "the ")
    ]
    assert kept.where("doc_id = 5").count() == 1 and kept.where("doc_id is null").count() == 2


def test_linked_sets_share_a_key():
    draw = np.random.default_rng(5)
    classes = jj.SizeClasses(9, 10)
    for _ in range(3000):
        n = int(draw.integers(1, 400))
        base = np.unique(draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        cut = int(draw.integers(0, max(1, n // 10 + 1)))
        other = np.unique(np.concatenate([base[cut:], draw.integers(0, 2**63, int(draw.integers(0, n // 15 + 1))).astype(np.uint64)]))
        both = jj.shared(base, other)
        if len(other) and 10 * both >= 9 * (len(base) + len(other) - both) and not np.array_equal(base, other):
            assert set(jj.part_keys(base, classes).tolist()) & set(jj.part_keys(other, classes).tolist())


@pytest.mark.parametrize("cross", [False, True])
@pytest.mark.parametrize("room", [64 << 20, 40_000])
def test_tree_finds_every_component(cross, room, monkeypatch):
    monkeypatch.setattr(jj, "BITMAP_BYTES", room)
    draw = random.Random(6)
    sets = []
    for _ in range(25):
        base = [draw.getrandbits(64) for _ in range(draw.choice([10, 30, 60, 61, 200]))]
        for _ in range(draw.randint(1, 14)):
            keep = [h for h in base if draw.random() > draw.choice([0.0, 0.02, 0.06])] or base
            sets.append(np.unique(np.array(keep + [draw.getrandbits(64) for _ in range(draw.choice([0, 0, 1, 3]))], np.uint64)))
    draw.shuffle(sets)
    left = list(range(len(sets)))
    right = left
    if cross:
        left, right = left[: len(left) // 3], left[len(left) // 3 :]
    links = jj.linked_pairs(left, right, sets, 9, 10)

    def labels(pairs):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    true = [(a, b) for a in left for b in right if a != b and 10 * (s := jj.shared(sets[a], sets[b])) >= 9 * (len(sets[a]) + len(sets[b]) - s)]
    assert labels(links) == labels(true)
    assert len(links) < len(sets)


@pytest.mark.parametrize("cross", [False, True])
@pytest.mark.parametrize("apart", [0.004, 0.02, 0.05])
def test_every_link_is_counted(cross, apart):
    """Near copies that differ little (counted by whole nodes), much, and about as much as is allowed."""
    draw = random.Random(8)
    sets = [np.unique(np.array([draw.getrandbits(64) for _ in range(40)], np.uint64)) for _ in range(5)]
    for n, size in ((120, 300), (70, 90), (3, 50)):
        base = [draw.getrandbits(64) for _ in range(size)]
        for _ in range(n):
            rest = [h for h in base if draw.random() > apart] + [draw.getrandbits(64) for _ in range(int(apart * size * draw.random()))]
            sets.append(np.unique(np.array(rest, np.uint64)))
    draw.shuffle(sets)
    copies = np.array([draw.choice([1, 1, 2, 900]) for _ in sets])
    left = list(range(len(sets)))
    right = left
    if cross:
        left, right = left[: len(left) // 3], left[len(left) // 3 :]
    links = jj.linked_pairs(left, right, sets, 9, 10)
    expected = np.zeros(len(sets), np.int64)
    for a in left:
        for b in right:
            both = jj.shared(sets[a], sets[b])
            if (cross or a < b) and 10 * both >= 9 * (len(sets[a]) + len(sets[b]) - both):
                expected[a] += copies[b]
                expected[b] += copies[a]
    assert (jj.counts_by_component(left, right, links, sets, copies, 9, 10) == expected).all()
    assert expected.sum() > 0


def test_bitmaps_are_bounded():
    for largest in (1, 3, 100, 20_000, 10**7):
        for members in (9, 1000, 40_000, 10**6):
            width = jj.bitmap_width(largest, members)
            assert width % 64 == 0 and width >= 256
            assert width == 256 or width * members <= jj.BITMAP_BYTES * 8


def test_graph_components(spark):
    draw = random.Random(7)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in parent.items() if k not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
