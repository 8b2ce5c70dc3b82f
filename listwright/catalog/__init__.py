"""The operators applied to the driver's tables, with the SQL that checks each of them."""

from listwright.catalog import incremental, ingest, reports, scale, triage  # noqa: F401  (registers)
from listwright.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
