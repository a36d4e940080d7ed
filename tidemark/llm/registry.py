"""Queries of the corpus operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from tidemark.llm import queries_chat, queries_fingerprints, queries_join, queries_leaks, queries_minhash, queries_quality, queries_repair, queries_score, queries_search, queries_spans, queries_tokens

_MODULES = (queries_chat, queries_fingerprints, queries_join, queries_leaks, queries_minhash, queries_quality, queries_repair, queries_score, queries_search, queries_spans, queries_tokens)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
