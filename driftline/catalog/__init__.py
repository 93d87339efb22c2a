"""Named queries over the supplied tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("drift", "quality", "performance", "attribution", "history", "models", "streams")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"driftline.catalog.{name}"), attribute).items():
            if key in merged:
                raise ValueError(f"query {key!r} is registered twice")
            merged[key] = value
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
