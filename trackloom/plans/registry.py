"""All registered queries of the library, with their SQL equivalents."""

from __future__ import annotations

from trackloom.plans import catalog, q_engine, q_enrollment, q_functions, q_galleries, q_geometry, q_history, q_identity, q_merging, q_metrics, q_rows, q_sequence, q_sources, q_streams  # noqa: F401


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    return dict(catalog.SQL)
