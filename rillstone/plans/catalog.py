"""Imports every module of queries, so that the registry is full."""

from rillstone.plans import learning, mining, readings, records, relations  # noqa: F401
from rillstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
