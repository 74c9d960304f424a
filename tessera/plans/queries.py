"""All queries of the driver, and their SQL."""

from __future__ import annotations

from . import image_queries, more_queries  # noqa: F401  each adds to the same two tables
from .driver_queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
