"""Queries over the given tables that exercise every operator."""

from checks import basic, scoring, analysis, recordings, signal  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
