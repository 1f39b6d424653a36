"""All registered queries of the engine and the SQL that must agree."""

from __future__ import annotations

from pagequarry.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
