"""Languages of a document as a mixture, from letter sequences.

Spark counts hashed three-letter sequences of all labelled rows, per language. A document is taken
as drawn from a mixture of these distributions: expectation-maximisation estimates the share of
each language, and the set of languages is the one with the largest penalised likelihood, tried
along the order of the shares. The likelihood of all languages together bounds that of every set,
so if it does not beat the best single language by the penalty, no further set is tried.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, read_table

BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 12
# Overlapping sequences are not independent: so many count as one in the likelihood.
OVERLAP = 3.0
LEAST_SHARE = 0.01
UNKNOWN = "und"
FOLDS = 5


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def buckets(text: str) -> np.ndarray:
    """Hash buckets of all three-character sequences with a letter; other characters are one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    points = np.where(is_letter, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    code = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA77)) ^ (points[2:] * np.uint32(0xC2B2AE3D))
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return code >> np.uint32(17)


def sequence_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows with a language; every task adds up its rows first."""

    def make():
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            sums: dict[str, np.ndarray] = {}
            for language, value in rows:
                if value:
                    if language not in sums:
                        sums[language] = np.zeros(BUCKETS, np.int64)
                    sums[language] += np.bincount(buckets(value), minlength=BUCKETS)
            for language, counts in sums.items():
                for b in np.flatnonzero(counts).tolist():
                    yield language, b, int(counts[b])

        return step

    labelled = df.where(F.col(lang).isNotNull())
    partial = map_rows(labelled, [lang, text], "lang string, bucket int, n bigint", make)
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by code point and the probability of each bucket (languages x BUCKETS).

    The driver gets at most BUCKETS counts for each label, whatever the number of rows.
    """
    counted = sequence_counts(df, text, lang).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    place = {n: i for i, n in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS))
    rows = [place[x] for x in counted.column("lang").to_pylist()]
    counts[rows, counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    counts += SMOOTHING
    return names, counts / counts.sum(axis=1, keepdims=True)


def shares(chances: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(shares, log likelihood) of the mixture of the rows of `chances`, by expectation-maximisation."""
    share = np.full(len(chances), 1 / len(chances))
    total = weights.sum()
    for _ in range(rounds):
        mixed = share @ chances
        share = share * (chances @ (weights / mixed)) / total
    return share, float(weights @ np.log(share @ chances))


def mixture(chances: np.ndarray, weights: np.ndarray) -> list[tuple[int, float]]:
    """(language number, share), largest share first, of the best penalised set.

    chances: languages x distinct sequences; weights: how often each occurs.
    """
    total = float(weights.sum())
    penalty = 0.5 * math.log(total + 1) * OVERLAP
    single = np.log(chances) @ weights
    best = int(np.argmax(single))
    every, limit = shares(chances, weights)
    chosen, value = [(best, 1.0)], float(single[best])
    if len(chances) == 1 or limit - value <= penalty:
        return chosen
    order = sorted(range(len(every)), key=lambda i: (-every[i], i))
    for size in range(2, len(order) + 1):
        if every[order[size - 1]] < LEAST_SHARE or limit - penalty * (size - 1) <= value:
            break
        tried = order[:size]
        share, likelihood = shares(chances[tried], weights)
        if likelihood - penalty * (size - 1) > value:
            value = likelihood - penalty * (size - 1)
            chosen = sorted(zip(tried, share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return chosen


def identify(
    df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """key, lang_pred, score (its share) and languages (all chosen, with shares).

    A null text, or one without letters, and every text if nothing was learned, is `und` with
    score 0 and no languages. Equal shares go to the language first by code point. Keys are
    passed on as they are (null, repeated rows stay); other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        names, chances = shared.value

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for k, value in rows:
                codes = buckets(value or "")
                if not len(codes) or not names:
                    yield k, UNKNOWN, 0.0, []
                    continue
                counts = np.bincount(codes, minlength=BUCKETS)
                distinct = np.flatnonzero(counts)
                found = mixture(chances[:, distinct], counts[distinct].astype(float))
                listed = [{"lang": names[i], "share": s} for i, s in found]
                yield k, names[found[0][0]], min(found[0][1], 1.0), listed

        return step

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return map_rows(df, [key, text], schema, make, lambda r: 256)


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Whether a row belongs to the fold that is never learned from (a null key does)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(documents.where(~held_out(F.col("doc_id"))))
    return identify(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages"
    )


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
