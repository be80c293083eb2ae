"""Queries over the driver's tables, and the SQL that they are held against."""

from . import iterative  # noqa: F401  adds to ORACLES
from .oracles import ORACLES
from .queries import QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
