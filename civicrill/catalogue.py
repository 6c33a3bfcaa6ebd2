"""Catalogue of the civic queries: each entry pairs a Spark query with equivalent SQL where SQL can express it."""

from __future__ import annotations

from civicrill.plans import budget, extraction, gate, geo, meetings, minutes, money, people, persons, planning, search, structure, texts, timeline, votes  # noqa: F401  they register their queries
from civicrill.plans.registry import ORACLE, QUERIES

FLAGSHIP = "counterparty_totals"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
