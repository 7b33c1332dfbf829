"""Every registered query by name."""

from . import account_queries, decision_queries, graph_queries, merchant_queries, metric_queries, profile_queries, registry_queries, stream_queries

QUERIES = {
    **account_queries.QUERIES, **metric_queries.QUERIES, **merchant_queries.QUERIES, **profile_queries.QUERIES, **registry_queries.QUERIES, **graph_queries.QUERIES,
    **decision_queries.QUERIES, **stream_queries.QUERIES,
}
