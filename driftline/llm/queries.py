"""The registered queries of the training-data operators, and their SQL where SQL has one."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op1_warc",
    "op2_sentencepiece",
    "op3_language_id",
    "op4_mixture",
    "op5_secrets",
    "op6_token_counts",
    "op7_nearest",
    "op8_chat",
    "op9_quality_rules",
    "op10_jaccard_join",
    "op11_near_embeddings",
    "op12_collocations",
    "op13_merkle_manifest",
)


def _merged(attribute: str) -> dict:
    return {
        key: value
        for name in MODULES
        for key, value in getattr(import_module(f"driftline.llm.{name}"), attribute).items()
    }


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
