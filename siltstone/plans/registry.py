"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from siltstone.plans import branches, evaluation, evidence, integrity, pipeline, relational, retrieval, sources, stored, streams, structure, texts

MODULES = [integrity, texts, structure, retrieval, branches, evidence, evaluation, relational, sources, stored, pipeline, streams]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
