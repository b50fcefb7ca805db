"""Queries by name, and their SQL."""

from __future__ import annotations

from lectern.plans import error_analysis, language, scoring, streams  # noqa: F401  (they register their queries)
from lectern.plans.base import QUERIES, SQL  # noqa: F401
