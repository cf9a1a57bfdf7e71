"""Registered queries on the shared tables, each beside the SQL it must agree with."""

from .base import oracles, queries, read
from . import climate_raster, forest_tables, modelling, roundtrips, statistics, tables  # noqa: F401  (fill the registry)

__all__ = ["oracles", "queries", "read"]
