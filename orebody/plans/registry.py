"""All base queries by name, and their SQL."""

from __future__ import annotations

from . import association, clusters, etl_queries, models, preparation, statistics  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
