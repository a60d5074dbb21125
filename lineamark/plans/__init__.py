"""Queries over the driver's tables by name, and the SQL that gives the same rows."""

from lineamark.plans.queries import QUERIES, SQL
from lineamark.plans import media, records  # noqa: F401  these register theirs

__all__ = ["QUERIES", "SQL"]
