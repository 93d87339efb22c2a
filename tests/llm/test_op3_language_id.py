"""Language mixtures."""

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import op3_language_id as lid


def test_shares_recover_a_mixture():
    draw = np.random.default_rng(3)
    chances = draw.dirichlet(np.ones(400) * 0.1, 3) * 0.999 + 0.001 / 400
    weights = draw.multinomial(20_000, 0.7 * chances[0] + 0.3 * chances[2]).astype(float)
    seen = weights > 0
    found = dict(lid.mixture(chances[:, seen], weights[seen]))
    assert set(found) == {0, 2}
    assert abs(found[0] - 0.7) < 0.02
    alone = draw.multinomial(20_000, chances[1]).astype(float)
    assert [x for x, _ in lid.mixture(chances, alone)] == [1]


def test_the_full_mixture_bounds_every_set():
    draw = np.random.default_rng(4)
    chances = draw.dirichlet(np.ones(50), 4)
    weights = draw.integers(1, 9, 50).astype(float)
    _, every = lid.shares(chances, weights, 200)
    for i in range(4):
        assert every >= weights @ np.log(chances[i]) - 1e-6


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = lid.op3_language_id(spark, folder).join(truth, "doc_id").where("held_out and lang is not null")
    right, total = found.where("lang = lang_pred").count(), found.count()
    assert total > 100 and right >= 0.97 * total


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score int"
    train = [(i, w and w * 30, l, 0) for i, (w, l) in enumerate([("der und das ", "de"), ("the of and ", "en"), ("x", None), (None, "fr")])]
    df = spark.createDataFrame(train, schema)
    model = lid.fit(df)
    assert model[0] == ["de", "en"]
    rows = [(None, "und das", None, 1), (1, None, "de", 1), (1, "123 !", "de", 1), (2, "", None, 1), (3, "the and of", None, 1)]
    found = {(r.doc_id, r.lang_pred): r.score for r in lid.identify(spark.createDataFrame(rows, schema), model).collect()}
    assert set(found) == {(None, "de"), (1, "und"), (2, "und"), (3, "en")}
    assert found[1, "und"] == 0 and 0 < found[3, "en"] <= 1
    nothing = lid.identify(df, lid.fit(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert lid.identify(df.limit(0), model).count() == 0


def test_fold_is_the_remainder_of_the_crc(spark):
    import zlib

    ids = [*range(50), None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", lid.held_out(F.col("doc_id")).alias("h"))
    for r in rows.collect():
        assert r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)


def test_document_in_two_languages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 1500")
    model = lid.fit(df)
    one = {r.lang: r.text[:1500] for r in df.select("lang", "text").collect()}
    mixed = spark.createDataFrame([(1, one["de"] + " " + one["fr"])], "doc_id long, text string")
    assert {x.lang for x in lid.identify(mixed, model).first().languages} == {"de", "fr"}
