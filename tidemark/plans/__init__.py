"""All queries of the listing engine."""

from . import decorated, engines, ingest, inventory, matching, merges, pages, records, scalars, streams  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
