"""All registered queries of this package and their checking SQL."""

from __future__ import annotations

from normtext.llm.queries import registry


def queries() -> dict:
    return dict(registry.queries)


def oracle_sql() -> dict:
    return dict(registry.sql)
