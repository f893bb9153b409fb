"""Queries of the evaluation and curation operators, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from tessella.plans import decisions, evaluation, exchange, inference, items, packing, provenance, relational, scoring, screening  # noqa: F401
from tessella.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
