"""The registered queries and, where DuckDB can run them, their SQL."""

from . import application_queries, balance_queries, fact_queries, holder_queries, lead_queries, ledger_queries, queue_queries, stream_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (ledger_queries, text_queries, application_queries, balance_queries, fact_queries, holder_queries, lead_queries, queue_queries, stream_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
