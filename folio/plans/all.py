"""Importing this registers every query."""

from folio.plans import pages, place, raster, records, shapes, text  # noqa: F401
from folio.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
