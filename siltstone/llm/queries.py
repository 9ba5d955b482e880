"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from siltstone.llm import q_encode, q_language, q_leaks, q_neardup, q_ranking, q_splits, q_text

MODULES = [q_splits, q_text, q_neardup, q_ranking, q_encode, q_leaks, q_language]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
