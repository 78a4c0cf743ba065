"""All queries on the analytics operators, with their SQL."""

from __future__ import annotations

from autobi.plans import scale_queries  # noqa: F401  registers its queries
from autobi.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
