"""Loads every registered query."""

from __future__ import annotations

from arealcast.plans import queries_grid, queries_quality, queries_sources, queries_stats, queries_tables  # noqa: F401
from arealcast.plans.registry import QUERIES

__all__ = ["QUERIES"]
