"""Where the modules of queries put their queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: One row a key, in the dialect of the SQL side; copies of a row are equal.
DOCS = "(select distinct on (doc_id) * from store_documents where doc_id is not null)"
CHUNKS = "(select distinct on (chunk_id) * from chunks where chunk_id is not null)"
PAIRS = "(select distinct on (document_id) * from pair_records where document_id is not null)"
EVENTS = "(select distinct on (event_id) * from pipeline_events where event_id is not null)"
VLM = "(select distinct on (doc_id) * from vlm_results where doc_id is not null)"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL that gives the same rows if there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql
            for name, table in (("docs", DOCS), ("chunks", CHUNKS), ("pairs", PAIRS), ("events", EVENTS), ("vlm", VLM)):
                text = text.replace("{" + name + "}", table)
            SQL[f.__name__] = text.replace("{{", "{").replace("}}", "}")
        return f

    return add
