"""Base rules and the language model, against plain definitions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftline.llm import op9_quality_rules as q


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered)


def test_measures():
    draw = random.Random(1)
    for _ in range(1500):
        text = "".join(draw.choice(["a ", "b ", "a", "\n", "a b c\n", "#", "é ", "\x85", "\x1f", "\t", "\r\n", " "]) for _ in range(draw.randint(0, 60)))
        assert q.measures(text) == plain_measures(text), repr(text)


def plain_model(counts, known):
    """Modified Kneser-Ney over tuples of symbols, by its recursive definition."""
    levels = {q.ORDER: Counter({g: n for g, n in counts.items() if g in known})}
    for size in range(q.ORDER - 1, 0, -1):
        levels[size] = Counter(g[1:] for g in levels[size + 1])
    fixed = {}
    for s, c in levels.items():
        of = Counter((counts if s == q.ORDER else c).values())
        fixed[s] = q.discounts([of[k] for k in range(1, 5)])
    by_context = {s: defaultdict(dict) for s in levels}
    for s, c in levels.items():
        for g, n in c.items():
            by_context[s][g[:-1]][g[-1]] = n

    def p(gram):
        size = len(gram)
        if not size:
            return 1 / 32
        known = by_context[size].get(gram[:-1])
        if not known:
            return p(gram[1:])
        less = lambda n: fixed[size][min(n, 3)]
        back = max(sum(map(less, known.values())) / sum(known.values()), 1e-9)
        n = known.get(gram[-1], 0)
        return (n - less(n) if n else 0) / sum(known.values()) + back * p(gram[1:])

    return p


def as_tuple(code):
    return tuple(int(code) >> 5 * i & 31 for i in range(q.ORDER - 1, -1, -1))


def test_model_is_kneser_ney():
    draw = random.Random(2)
    text = " ".join("".join(draw.choice("abcd") for _ in range(draw.randint(1, 6))) for _ in range(300))
    codes = q.SymbolTable().codes(text)
    keys, counts = np.unique(codes, return_counts=True)
    known = keys % 3 > 0
    model = q.KneserNey(keys[known], counts[known], {0: q.frequencies(counts)})
    plain = plain_model(Counter(map(as_tuple, codes)), set(map(as_tuple, keys[known])))
    tried = np.unique(np.concatenate([keys[:200], q.SymbolTable().codes("zebra acd 42 qq"), codes[:50] ^ 3])).astype(np.uint32)
    for code, score in zip(tried, model.score(tried), strict=True):
        assert score == pytest.approx(math.log2(plain(as_tuple(code))), abs=1e-4)
    sums = np.exp2(model.score(np.arange(32**4, dtype=np.uint32))).reshape(-1, 32).sum(1)
    assert np.allclose(sums, 1, atol=1e-4)


def test_symbols():
    table = q.SymbolTable()
    assert as_tuple(table.codes("É")[0])[-1] == 4 and as_tuple(table.codes("7")[0])[-1] == q.DIGIT
    assert len(table.codes("a \n\t b")) == 3 and len(table.codes("")) == 0
    assert len(table.codes("東😀")) == 2


@pytest.fixture(scope="module")
def prose(spark):
    draw = random.Random(3)
    words = ["".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(120)), "en" if i % 2 else None, "k") for i in range(60)]
    junk = "".join(chr(draw.randint(33, 126)) + " " * (i % 4 == 0) for i in range(2000))
    rows += [(1000, junk, "en", "k"), (1001, "few words", "en", "k"), (1002, None, "en", "k"), (1003, "", None, "k"), (1004, "one two three " * 60, "en", "k")]
    rows += [(None, rows[0][1], "en", "k"), (1, rows[1][1], "en", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")


def test_verdicts(prose):
    got = q.quality(prose).collect()
    assert len(got) == prose.count()
    by_id = {r.doc_id: r for r in got}
    assert not by_id[1000].base_failed and not by_id[1000].kept  # outside the band
    assert all(by_id[i].base_failed and not by_id[i].kept for i in (1001, 1002, 1003, 1004))
    assert all(r.kept for r in got if r.doc_id is None or r.doc_id < 1000)
    for r in prose.collect():
        mine = next(x for x in got if x.doc_id == r.doc_id)
        assert tuple(mine[m] for m in q.MEASURES) == plain_measures(r.text or "")
    kept = q.good_rows(prose)
    assert kept.columns == prose.columns and kept.count() == sum(r.kept for r in got)
    assert q.quality(prose.limit(0)).count() == 0 and q.good_rows(prose.limit(0)).count() == 0


def test_counts_are_exact(spark, prose):
    total, docs = Counter(), Counter()
    for r in prose.collect():
        codes = (q.SymbolTable().codes(r.text or "") | np.uint32(q.model_of(r.lang) << 20)).tolist()
        total.update(codes)
        docs.update(set(codes))
    assert {r.gram: (r.n, r.docs) for r in q.gram_counts(prose).collect()} == {g: (n, docs[g]) for g, n in total.items()}
