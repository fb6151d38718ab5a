"""Registered queries and their SQL. The given tables stand in for captures: ``roles`` says which columns play which part."""

from . import fields, queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "fields", "queries"]
