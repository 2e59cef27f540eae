"""Queries of the sensor operators and their SQL."""

from __future__ import annotations

from gridwake.plans import device_queries, grid_queries, motion_queries
from gridwake.plans.grid_queries import flagship

_MODULES = (grid_queries, motion_queries, device_queries)
__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}
