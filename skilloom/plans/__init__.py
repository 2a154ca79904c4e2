"""Registered queries by area, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

AREAS = ("matching", "reporting", "documents", "claims", "operations", "storage", "records")


def _merged(attr: str) -> dict:
    out: dict = {}
    for area in AREAS:
        part = getattr(import_module(f"skilloom.plans.{area}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
