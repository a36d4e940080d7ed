"""Queries over the measurement tables and the SQL that checks them."""

from __future__ import annotations

from tidemark.plans import queries_campaigns, queries_context, queries_decisions, queries_history, queries_ledger, queries_metrics, queries_sources, queries_writes

_MODULES = (queries_metrics, queries_campaigns, queries_history, queries_decisions, queries_writes, queries_ledger, queries_context, queries_sources)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
