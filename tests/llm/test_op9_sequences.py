"""The model of characters as they stand, against Kneser-Ney by its recursive definition, and its growth."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftline.llm import op9_quality_rules as q


def plain_sequences(text):
    points = " " * (q.REACH - 1)
    for i, c in enumerate(text):
        blank = c in q.BLANKS
        if not (blank and i and text[i - 1] in q.BLANKS):
            points += " " if blank else c
    return [points[i : i + q.REACH] for i in range(len(points) - q.REACH + 1)]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    # Capitals, accents, scripts, digits and marks, NUL among them, and more characters than RADIX in one text.
    words = ["".join(draw.choice("abcABCéçж東京😀7#\x00\xa0") for _ in range(draw.randint(1, 6))) for _ in range(60)]
    rows = [(" ".join(draw.choice(words) + draw.choice(["", "\n ", "\t"]) for _ in range(80)), lang) for lang in ("de", None, "") for _ in range(12)]
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + q.RADIX + 50)))
    return rows + [(rows[0][0], "de"), (None, "de"), ("", None), (" \n", "de"), (wide, "zz"), (wide[::-1], "zz"), (wide[:300], "zz")]


@pytest.fixture(scope="module")
def counted(spark, rows):
    return q.sequence_counts(spark.createDataFrame(rows, "text string, lang string").repartition(2))


def plain_counts(rows):
    total, texts = Counter(), defaultdict(set)
    for text, lang in rows:
        for g in plain_sequences(text or ""):
            total[q.label_of(lang), g] += 1
            texts[q.label_of(lang), g].add(zlib.crc32(text.encode()))
    return total, texts


def test_counts_are_exact(counted, rows):
    total, texts = plain_counts(rows)
    got = {(r.label, r.gram): (r.n, r.low, r.high) for r in counted.collect()}
    assert got == {g: (n, min(texts[g]), max(texts[g])) for g, n in total.items()}


def test_packed_sequences_are_merged(rows):
    packer, parts, plain = q.Packer(), [], {}
    for i, (text, _) in enumerate(rows[:6] + rows[:2]):
        packed = packer.pack([q.unfolded(text)])
        parts.append(q.distinct(packed, np.full(len(packed), i % 6)))
        for g in plain_sequences(text):
            n, low, high = plain.get(g, (0, i % 6, i % 6))
            plain[g] = n + 1, min(low, i % 6), max(high, i % 6)
    packed, *columns = q.merged(parts)
    grams = q.as_strings(packer.unpack(packed))
    assert dict(zip(grams.to_pylist(), zip(*(c.tolist() for c in columns), strict=True), strict=True)) == plain
    assert (q.as_points(grams) == packer.unpack(packed)).all()


def test_scores_are_kneser_ney(counted, rows):
    total, texts = plain_counts(rows)
    table = q.SymbolTable()
    symbol = lambda c: int(table.fold(np.array([ord(c)], np.uint32))[0])
    for label in ("=de", "", "=", "=zz"):
        counts = {g: n for (x, g), n in total.items() if x == label}
        levels = {q.REACH: Counter({g: n for g, n in counts.items() if len(texts[label, g]) > 1})}
        for size in range(q.REACH - 1, 0, -1):
            levels[size] = Counter(g[1:] for g in levels[size + 1])
        fixed = {}
        for size, c in levels.items():
            of = Counter((counts if size == q.REACH else c).values())
            fixed[size] = q.discounts([of[k] for k in range(1, 5)])
        after = {s: defaultdict(dict) for s in levels}
        for size, c in levels.items():
            for g, n in c.items():
                after[size][g[:-1], symbol(g[-1])][g[-1]] = n

        def p(gram, after=after, fixed=fixed):
            if not gram:
                return 0.0, 1.0
            lower, rest = p(gram[1:])
            known = after[len(gram)].get((gram[:-1], symbol(gram[-1])))
            if not known:
                return lower, rest
            less = lambda n: fixed[len(gram)][min(n, 3)]
            back = max(sum(map(less, known.values())) / sum(known.values()), 1e-9)
            n = known.get(gram[-1], 0)
            return (n - less(n) if n else 0) / sum(known.values()) + back * lower, back * rest

        got = {r.gram: (r.p, r.rest) for r in q.sequence_scores(counted).where(f"label = '{label}'").collect()}
        assert set(got) == set(counts)
        for gram, found in got.items():
            assert found == pytest.approx(p(gram), rel=1e-9, abs=1e-15), (label, gram)


def test_perplexity_is_the_mean_of_the_model(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    scores = {(r.label, r.gram): r for r in q.sequence_scores(q.sequence_counts(df)).collect()}
    table, shapes = q.SymbolTable(), q.fit(df)
    assert table.members.sum() == q.POINTS

    def log_p(lang, gram):
        code = shapes.numbers[lang]
        for symbol in table.fold(np.array([ord(c) for c in gram[-q.ORDER :]], np.uint32)):
            code = code << q.BITS | int(symbol)
        own = scores[q.label_of(lang), gram]
        shape = shapes.score(np.array([code]))[0]
        return shape + math.log2(own.p + own.rest / table.members[code & 31]), shape

    for r in q.quality(df).collect():
        text, lang = rows[r.doc_id]
        if not text:
            assert r.log_perplexity is None and r.shape_perplexity is None
            continue
        both, shape = np.mean([log_p(lang, g) for g in plain_sequences(text)], axis=0)
        assert (r.log_perplexity, r.shape_perplexity) == pytest.approx((-both, -shape), rel=1e-4)


def test_characters_of_one_symbol_differ(spark):
    # All of these fold to the same symbols: capitals, accents, other scripts, digits and marks.
    letters = "etaoinshrdlu"
    far = {c: chr(0x4E00 - 0x4E00 % 26 + 26 * 7 * i + ord(c) - 97) for i, c in enumerate(letters)}
    changes = [str.upper, lambda x: x.translate(str.maketrans("eaou", "éàôü")), lambda x: x.translate(str.maketrans(far)),
               lambda x: x.translate(str.maketrans("123(", "987{"))]
    draw = random.Random(9)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(100)] + ["1", "23", "(123)"] * 5
    text = lambda: " ".join(draw.choice(words) for _ in range(200))
    table, odd = q.SymbolTable(), []
    for change in changes:
        plain = text()
        odd.append(change(plain))
        assert odd[-1] != plain and table.codes(odd[-1]).tobytes() == table.codes(plain).tobytes()
    rows = [(i, x, "de") for i, x in enumerate([*odd, *(text() for _ in range(150))])]
    got = {r.doc_id: r for r in q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(r.kept for i, r in got.items() if i >= len(odd))
    assert all(got[i].log_perplexity > got[i].high and not got[i].kept for i in range(len(odd)))


def test_model_grows_with_the_rows(spark):
    # All texts are of the same letters to the 32 symbols, so that their model stays as it is.
    draw = random.Random(10)
    texts = []
    for block in range(40):
        start = 0x4E00 + 26 * 20 * block
        letters = [chr(start - start % 26 + 26 * i + draw.randrange(26)) for i in range(20)]
        text = " ".join("".join(draw.choice(letters) for _ in range(3)) for _ in range(200))
        texts += [text, text + " "]
    sizes = []
    for n in (20, 40, 80):
        df = spark.createDataFrame([(x, "zh") for x in texts[:n]], "text string, lang string")
        known = q.sequence_counts(df).where("low < high").count()
        stored = spark.read.parquet(q.stored_model(df))
        assert stored.count() >= known and stored.select("key").distinct().count() == stored.count()
        sizes.append(known)
    assert sizes[1] > 1.9 * sizes[0] and sizes[2] > 1.9 * sizes[1]


def test_both_bands_reject(spark):
    near = [(i, "en", (False, 3.0 + i / 1000, 2.0 + i / 1000)) for i in range(40)]
    far = [(100, "en", (False, 3.0, 1.0)), (101, "en", (False, 3.0, 3.0)), (102, "en", (False, 2.0, 2.0)), (103, "en", (False, 4.0, 2.0))]
    schema = "doc_id long, lang string, z struct<base_failed: boolean, log_perplexity: double, shape_perplexity: double>"
    judged, band, verdict = q.judge(spark.createDataFrame([*near, *far, (200, "en", (True, 3.0, 2.0))], schema), "z")
    assert {r.doc_id for r in judged.where(verdict).collect()} == set(range(40))
    assert judged.select(f"{band}.*").columns == ["low", "high", "shape_low", "shape_high"]
