"""Meeting keys of rare shingles: no link is lost, and shared passages connect nothing."""

import random
from collections import Counter

import numpy as np
import pytest

from driftline.llm import op10_jaccard_join as jj


def test_linked_sets_meet_whatever_is_common():
    draw, classes, met = np.random.default_rng(1), jj.SizeClasses(4, 5), 0
    for trial in range(600):
        n = int(draw.integers(5, 500))
        hashes = draw.integers(0, 2**64, 2 * n, np.uint64)
        base = np.unique(hashes[:n])
        gone = draw.integers(0, n // 5 + 1)
        other = np.unique(np.concatenate([base[draw.permutation(n)[gone:]], hashes[n : n + int(draw.integers(0, n // 5 + 1))]]))
        both = len(np.intersect1d(base, other))
        if 5 * both < 4 * (len(base) + len(other) - both):
            continue
        met += 1
        share = draw.choice([0.0, 0.1, 0.5, 0.9, 1.0])
        rare = lambda s: s[(s % np.uint64(1000)) >= 1000 * share]
        keys = [set(jj.part_keys(s, classes, rare(s)).tolist()) for s in (base, other)]
        assert keys[0] & keys[1] or np.array_equal(base, other), (trial, n, share)
    assert met > 100


@pytest.fixture(scope="module")
def passages(spark):
    """Unlike texts that share passages, near copies of some of them, and texts of passages alone."""
    draw = random.Random(4)
    shared = [" ".join(f"p{i}_{k}" for k in range(40)) for i in range(8)]
    own = lambda: " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(200))
    rows = [" ".join([own(), draw.choice(shared), own()]) for _ in range(400)]
    for i in range(0, 400, 40):
        words = rows[i].split()
        words[20] = "other"
        rows.append(" ".join(words))
    rows += [" ".join(shared[:5]), " ".join(shared[:4] + [shared[4][:-4]]), None, "", rows[7]]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)


def test_common_shingles_are_those_of_many_sets(passages, monkeypatch):
    monkeypatch.setattr(jj, "COUNTED", 20_000)  # several packed tables for a task
    shingle, times = jj.Shingler(5), Counter()
    sets = {tuple(shingle(r.text or "").tolist()) for r in passages.collect()}
    for s in sets:
        times.update(x >> 32 for x in s)
    often = {x >> 5 for x, n in times.items() if n > jj.COMMON}
    bits = jj.common_shingles(passages.coalesce(1), "text", 5)
    found = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    assert often and set(found.tolist()) == often


def test_shared_passages_connect_nothing(passages):
    def connected(common):
        at = Counter((r.k, r.member) for r in jj.meetings(passages, "text", 5, 4, 5, common).collect())
        groups = Counter(k for k, _ in at)
        return {m for k, m in at if groups[k] > 1}

    assert len(connected(None)) > 300
    assert len(connected(jj.common_shingles(passages, "text", 5))) < 30
    rows = lambda **o: sorted(map(tuple, jj.component_table(passages, width=5, p=4, q=5, **o).collect()))
    assert rows(rare_keys=True) == rows()
    assert sum(r[0] != r[2] for r in rows(rare_keys=True)) == 12


def test_empty_table(passages):
    assert not jj.common_shingles(passages.limit(0), "text", 5).any()
    assert jj.component_table(passages.limit(0), rare_keys=True).count() == 0
