"""The queries of the engine by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .plans import boxes, events, grids, orders, slides, text  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
