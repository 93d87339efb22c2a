"""Each language has its own model, and both sides of its band reject."""

import random

import pytest

from driftline.llm import op9_quality_rules as q


def words_of(draw, letters):
    return ["".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(300)]


@pytest.fixture(scope="module")
def judged(spark):
    """Clean texts of two languages that crc32 modulo 16 takes as one, and junk on both sides."""
    assert q.model_of("de") == q.model_of("es")
    draw = random.Random(5)
    spoken = {"de": words_of(draw, "enirst"), "es": words_of(draw, "aoldcu")}
    text = lambda lang, n=150: " ".join(draw.choice(spoken[lang]) for _ in range(n))
    rows = [(1000 * k + i, text(lang), lang) for k, lang in enumerate(spoken) for i in range(150)]
    few = spoken["de"][:12]
    rows += [(5000 + i, text("es"), "de") for i in range(2)] + [(5100 + i, text("de"), "es") for i in range(2)]
    rows += [(5200 + i, " ".join(w.upper() + "!!" for w in text("de").split()), "de") for i in range(2)]
    rows += [(5300 + i, " ".join(draw.choice(few) for _ in range(150)), "de") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r.doc_id: r for r in q.quality(df).collect()}


def test_clean_texts_stay(judged):
    assert all(r.kept for i, r in judged.items() if i < 5000)


def test_texts_of_another_language_go(judged):
    for i, r in judged.items():
        if 5000 <= i < 5200:
            assert not r.base_failed and not r.kept and r.log_perplexity > r.high, r


def test_mild_junk_goes_on_both_sides(judged):
    for i, r in judged.items():
        if i >= 5200:
            assert not r.base_failed and not r.kept, r
            assert r.log_perplexity > r.high if i < 5300 else r.log_perplexity < r.low
