"""All registered queries and their checking SQL."""

from __future__ import annotations

import importlib

AREAS = ["selection", "tables", "drift", "experiments", "specs", "debates", "passages", "checks", "intake"]


def _merge(attribute: str) -> dict:
    merged: dict = {}
    for area in AREAS:
        part = getattr(importlib.import_module(f"normtext.plans.{area}").registry, attribute)
        assert not merged.keys() & part.keys()
        merged |= part
    return merged


def queries() -> dict:
    return _merge("queries")


def oracle_sql() -> dict:
    return _merge("sql")
