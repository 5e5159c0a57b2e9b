"""All queries by name: (Spark callable, SQL text or None)."""

from catalog import (
    build_queries, contract_queries, evidence_queries, file_queries, governance_queries, match_queries, message_queries, overlay_queries,
    store_queries, stream_queries,
)

ALL = {
    **match_queries.QUERIES, **evidence_queries.QUERIES, **message_queries.QUERIES,
    **overlay_queries.QUERIES, **governance_queries.QUERIES, **stream_queries.QUERIES,
    **build_queries.QUERIES, **contract_queries.QUERIES, **store_queries.QUERIES, **file_queries.QUERIES,
}
