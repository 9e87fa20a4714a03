"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from barlight.plans import bar_queries, ledger_queries, stats_queries, stream_queries, text_queries

MODULES = [bar_queries, text_queries, ledger_queries, stats_queries, stream_queries]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
