"""Every oracle by query name."""

from . import sql_alerts, sql_decisions, sql_graph, sql_merchant, sql_metrics, sql_profiles, sql_registry, sql_streams

SQL = {
    **sql_alerts.SQL, **sql_metrics.SQL, **sql_merchant.SQL, **sql_profiles.SQL, **sql_registry.SQL, **sql_graph.SQL, **sql_decisions.SQL, **sql_streams.SQL,
}
