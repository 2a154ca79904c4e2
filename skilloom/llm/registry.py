"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("html", "ngram", "sentencepieces", "quality", "token_counts", "simhash", "packing", "secrets", "licenses", "merkle", "infilling",
           "centroids", "neighbours")


def _merged(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"{__package__}.{name}"), attr))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
