"""Named queries on the driver tables, most with the SQL that gives the same rows."""

from slotlake.catalog.registry import ORACLES, QUERIES

from slotlake.catalog import evaluation, models, profiles, rows, tables  # noqa: F401  (they register)

__all__ = ["ORACLES", "QUERIES"]
