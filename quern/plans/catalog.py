"""All named queries of the engine."""

from __future__ import annotations

from . import catalog_graph, catalog_lifecycle, catalog_memory, catalog_records, catalog_relational, catalog_text, catalog_vectors  # noqa: F401
from .registered import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
