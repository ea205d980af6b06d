"""All driver queries and their SQL; importing a plan module registers its queries."""

from __future__ import annotations

from stratiform.plans import appendix, articles, assembly, events, graph, planning, providers, quality, results, retrieval, rollups, sections, sessions, shapes, spatial, store, text  # noqa: F401
from stratiform.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
