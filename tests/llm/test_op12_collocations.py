"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftline.llm import op12_collocations as coll

SCHEMA = "doc_id long, text string, lang string, word string, n int, range string, head string"


def brute(rows, least, longest=5, top=2000, share=(100, 100)):
    counts, size = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            size[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = set()
        for p, c in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    if share[0] * c >= share[1] * f[p[i : i + n]]:
                        held.add(p[i : i + n])
        kept = []
        for p, a in candidates.items():
            if p not in held:
                score, k = min((1000 * a * size[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, size[lang], -score))
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, "w", 1, "r", "h") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in coll.collocations(df, **options).collect())


def corpus(seed, docs=120):
    draw = random.Random(seed)
    words = ["New", "york", "the", "of", "Ünder", "a\x01b", "z\x85y", "x-y", "日本", "iİ"] + [f"w{i}" for i in range(15)]
    rows = []
    for _ in range(docs):
        parts = [draw.choice(words) for _ in range(draw.randint(0, 60))]
        text = "".join(w + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", " "]) for w in parts)
        rows.append((text + draw.choice(["", " new york city hall of", " New  York. city hall"]), draw.choice(["en", "de", None, "", "und"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_counts(spark, seed):
    rows = corpus(seed)
    rows += [(None, "en"), ("", "en"), (" \t\n.,", None), ("to be or not to be", "en"), ("aa " * 300, "de")] * 2
    assert found(spark, rows, least=4) == brute(rows, 4)
    assert found(spark, rows, least=3, longest=3, top=5, share=(4, 3)) == brute(rows, 3, 3, 5, (4, 3))
    assert found(spark, [], least=2) == []


def test_shards_and_long_texts(spark, monkeypatch):
    """Many small shards, and texts taken in chunks, give the same counts."""
    monkeypatch.setattr(coll, "SHARD_WORDS", 50)
    monkeypatch.setattr(coll, "CHUNK", 64)
    rows = corpus(9)
    shards = list(coll.over_shards(iter((lang or "und", text) for text, lang in rows), lambda lang, s: [(lang, s.sequence().tolist(), s.words())]))
    assert len(shards) > 10
    for size in (1, 7, 64, 10**6):
        monkeypatch.setattr(coll, "CHUNK", size)
        one = coll.Shard()
        one.add("Ab cd. ef gh\tij, k " * 5 + "x" * 200 + " end")
        words = one.words()
        text = " ".join(words[i] for i in one.sequence())
        assert re.sub(r"( \.)+", " .", text) == "ab cd . ef gh ij . k " * 5 + "x" * 200 + " end ."


def test_a_million_words(spark):
    rows = [("lorem ipsum dolor sit " * 250_000, "en"), ("x" * 1_000_000, "en")]
    got = found(spark, rows, least=100)
    assert got == brute(rows, 100)


def test_builder_shares_states():
    build = coll.Builder()
    for words, count in ((["a", "c"], 2), (["a", "d"], 1), (["b", "c"], 2), (["b", "d"], 1), (["c"], 5)):
        build.add(words, count)
    state = build.finish()
    assert state[0][0::2] == ("a", (("c", 2, ()), ("d", 1, ()))) and state[0][1] == 3
    assert state[0][2] is state[1][2] and state[2] == ("c", 5, ())
    total = {}
    coll.add_state(total, state)
    coll.add_state(total, state)
    assert coll.pruned(total, 4) == (("a", 6, (("c", 4, ()),)), ("b", 6, (("c", 4, ()),)), ("c", 10, ()))


def test_scores_beyond_64_bits(spark):
    """The score's products pass 64 bits; the arithmetic is the one of the query."""
    from pyspark.sql import functions as F

    a, n, l, r = 3_000_000_019, 9_000_000_000_041, 5_000_000_029, 7_000_000_001
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.select(F.expr(coll.SCORE)).first()[0] == 1000 * a * n // (l * r)


def test_filter_never_hides_a_frequent_pair(spark):
    keys = np.arange(1000, dtype=np.uint32)
    places = coll.filter_places(np.zeros(1000, np.int64), keys)
    assert ((places >= 0) & (places < coll.FILTER_BITS)).all() and len(set(places.tolist())) > 990
