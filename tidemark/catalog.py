"""All registered queries of the operators outside tidemark.llm, by name, with the SQL that checks them."""

from __future__ import annotations

from .plans import analysis, coerced, completed, hooks, listing, lookups, payloads, scalars, streams
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "coerced", "completed", "hooks", "listing", "lookups", "payloads", "scalars", "streams"]
