"""All registered queries: name -> (Spark query, SQL or None)."""

from __future__ import annotations

from chatwarden.plans import (
    metric_queries,
    model_queries,
    review_queries,
    stream_queries,
    vector_queries,
    window_queries,
)

QUERIES = {
    **window_queries.QUERIES,
    **vector_queries.QUERIES,
    **metric_queries.QUERIES,
    **review_queries.QUERIES,
    **model_queries.QUERIES,
    **stream_queries.QUERIES,
}
