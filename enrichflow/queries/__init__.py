"""Query catalogue."""
from enrichflow.queries import details, discovery, enriching, joining, reporting, selecting  # noqa: F401
from enrichflow.queries.registry import CATALOG

__all__ = ["CATALOG"]
