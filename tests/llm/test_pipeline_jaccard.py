"""The Jaccard stage of the pipeline against all pairs of five-word shingles."""

import random

import corpus_pipeline
from driftline.llm.op10_jaccard_join import component_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near(a, b, width, least):
    a, b = shingles(a, width), shingles(b, width)
    return len(a & b) >= least * len(a | b)


def corpus():
    """Pairs of 1,000-word texts with scattered one-word edits, on both sides of 0.8."""
    draw = random.Random(11)
    rows = []
    for edits in (2, 10, 16, 18, 20, 22, 24, 26, 30, 60):
        base = [f"w{draw.randint(0, 10**6)}" for _ in range(1000)]
        other = list(base)
        for at in draw.sample(range(5, 995, 10), edits):
            other[at] = f"x{draw.randint(0, 10**6)}"
        rows += [(len(rows) + k, " ".join(words), "en", "a", 1) for k, words in enumerate((base, other))]
    return rows


def test_stage_keeps_one_of_five_word_components(spark):
    rows = corpus()
    gone = {j for i, a, *_ in rows for j, b, *_ in rows if i < j and near(a, b, 5, 0.8)}
    thin = {j for i, a, *_ in rows for j, b, *_ in rows if i < j and near(a, b, 3, 0.9)}
    assert thin < gone and len(gone - thin) >= 3
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.jaccard_join(spark, df, "").collect()}
    assert kept == {r[0] for r in rows} - gone


def test_stage_agrees_with_the_join_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = component_table(docs, width=5, p=4, q=5).where("doc_id = component_id")
    kept = corpus_pipeline.jaccard_join(spark, docs, small)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found.collect())
