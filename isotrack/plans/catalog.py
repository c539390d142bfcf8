"""All named queries and their SQL."""

from . import crossings, fits, registry, relational, resampled, sensitivity, simulation, statistics, trends
from .registry import ORACLE, QUERIES, flagship

__all__ = ["ORACLE", "QUERIES", "crossings", "fits", "flagship", "registry", "relational", "resampled", "sensitivity", "simulation", "statistics", "trends"]
