"""All registered queries and their SQL."""

from .plans import analytics, graphs, intake, search, streams  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
