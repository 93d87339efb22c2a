"""The corpus pipeline over `documents`: quality rules, one document of each near-duplicate
component, secrets masked, sources mixed to target weights, and SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. Between stages the rows are written to the cluster's shared folder.

The intermediate tables of a stage are deleted when the next one begins: its result has been
written by then, as that is what the next one reads. So write a stage's result before calling another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import op2_sentencepiece, op4_mixture, op5_secrets, op9_quality_rules, op10_jaccard_join
from driftline.llm.common import read_table
from driftline.session import drop_paths, materialise, recorded_paths

_left: list[str] = []


def _tidy(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_paths(spark, _left)
        with recorded_paths() as own:
            result = stage(spark, docs, sf_dir)
        _left[:] = own
        return result

    return run_stage


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail the base rules or lie outside their language's band."""
    return op9_quality_rules.good_rows(docs)


@_tidy
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are 0.8 alike or more.

    The op10 query has three words and 0.9; that setting is its own."""
    return op10_jaccard_join.one_of_each(docs, width=5, p=4, q=5, rare_keys=True)


@_tidy
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With secrets masked in the text, and n_chars of the new text."""
    masked = op5_secrets.mask_secrets(docs)
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


@_tidy
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    _, decided = op4_mixture.mix(docs)
    return op4_mixture.repeat_rows(docs, decided)


@_tidy
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and source bytes, for every row."""
    return op2_sentencepiece.digests(docs, public_tokenizers.path(op2_sentencepiece.MODEL))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("secrets", secrets),
    ("mixture", mixture),
    ("sentencepiece", sentencepiece),
]

# Perplexity bands and the random mix have no SQL form; the tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
