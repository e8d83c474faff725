"""All named queries with their SQL."""

from __future__ import annotations

from tidewell.plans import aggregates, filters, joins, scalars, scans, search, sets, state, windows  # noqa: F401
from tidewell.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
