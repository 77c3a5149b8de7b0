"""All registered queries."""

from stationloom.registry import models, rows, tables  # noqa: F401
from stationloom.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
