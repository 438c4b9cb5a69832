"""All queries of the core by name."""

from __future__ import annotations

from lodestone.plans import drift_queries, further_queries, graph_queries, io_queries, more_queries, registry, relational_queries, text_queries  # noqa: F401  (they register their queries)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)


def flagship(spark, folder):
    """A question answered from all documents: chunks, vectors, nearest chunks and their documents."""
    return graph_queries.retrieval(spark, folder)
