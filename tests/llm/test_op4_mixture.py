"""Target weights and the cube method."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import op4_mixture as mix


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s] - 1e-12]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_flight_keeps_sums():
    draw = random.Random(1)
    sizes = [draw.choice([1, 5, 5, 7, 1000]) for _ in range(500)]
    chances = [draw.random() for _ in sizes]
    after = mix.flight(sizes, chances, draw.random)
    assert sum(0 < p < 1 for p in after) <= 2
    assert sum(after) == pytest.approx(sum(chances), abs=1e-4)
    assert sum(p * s for p, s in zip(after, sizes, strict=True)) == pytest.approx(sum(p * s for p, s in zip(chances, sizes, strict=True)), rel=1e-6)


def test_flight_is_fair():
    draw = random.Random(2)
    total = [0.0] * 6
    for _ in range(4000):
        after = mix.flight([1, 2, 3, 4, 5, 6], [0.3, 0.5, 0.7, 0.2, 0.6, 0.4], draw.random)
        total = [a + b for a, b in zip(total, after, strict=True)]
    assert [t / 4000 for t in total] == pytest.approx([0.3, 0.5, 0.7, 0.2, 0.6, 0.4], abs=0.04)


SOURCES = ["b", "a", None, "Z", "é", "c", ""]


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.choice([0, 1, 3, 50, 400]), SOURCES[min(draw.randint(0, 9), 6)], 1) for i in range(900)]
    rows += [(None, "no id here", "a", 2)] * 3 + [(4, None, "b", 3), (5, "one two", "b", 4), (5, "one two", "b", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(5)


@pytest.mark.parametrize("block", [4096, 16])
def test_targets_and_sums(docs, block):
    rows, decided = mix.mix(docs, block_size=block)
    got = rows.collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    wanted = plain_targets(sizes)
    for source, size in sizes.items():
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {size}
        assert mine[0].target == pytest.approx(wanted[source])
        assert sum(r.taken for r in mine) == pytest.approx(wanted[source], abs=400 if block == 4096 else 900)
    again = mix.mix(docs.repartition(3), block_size=block)[0]
    key = lambda r: str(tuple(r))
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    repeated = mix.repeat_rows(docs, decided)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.copies for r in got if r["size"] > 0)


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    empty = spark.createDataFrame([], schema)
    rows, decided = mix.mix(empty)
    assert rows.count() == 0 and mix.repeat_rows(empty, decided).count() == 0
    rows, _ = mix.mix(spark.createDataFrame([(1, None, "a"), (2, " \n", None)], schema))
    assert [(r["size"], r.target, r.taken) for r in rows.collect()] == [(0, 0.0, 0)] * 2


def test_words_are_cut_at_six_characters_only(spark):
    text = "a b c d\x0be\x1ff\x85g\r\nh"
    size = spark.createDataFrame([(text,)], "t string").select(mix.word_count(F.col("t"))).first()[0]
    assert size == len([w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w])
