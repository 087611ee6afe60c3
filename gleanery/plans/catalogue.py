"""All registered queries of the engine itself."""

from __future__ import annotations

from gleanery.plans import labels, measures, projects, rasters  # noqa: F401
from gleanery.plans.relational import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
