"""Queries over the driver's tables, one per operator, each beside the SQL that must give the same rows."""

from __future__ import annotations

from granary.plans import audit_queries, augment_queries, build_queries, data_queries, evaluation_queries, graph_queries, metric_queries, report_queries, rowmap_queries, store_queries, stream_queries, text_queries, training_queries

MODULES = (data_queries, rowmap_queries, evaluation_queries, graph_queries, augment_queries, text_queries, metric_queries, audit_queries, training_queries, stream_queries, store_queries, build_queries, report_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
