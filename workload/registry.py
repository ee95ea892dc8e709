"""All registered queries: name -> (function of session and directory, DuckDB text or None)."""

from workload import metric_queries, report_queries, state_queries, table_queries

QUERIES = {**state_queries.QUERIES, **metric_queries.QUERIES, **table_queries.QUERIES, **report_queries.QUERIES}
ENTRY = metric_queries.flagship
