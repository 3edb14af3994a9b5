"""Every registered query of the engine and the SQL it is held against."""

from __future__ import annotations

from quillon.plans import catalogues, classification, corpora, curation, evaluation, forms, genre, layout, pages, protocols, records, registry, smallforms, stylometry, surface  # noqa: F401  (query modules register themselves)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
