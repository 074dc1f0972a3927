"""All queries of the library outside the corpus operators, and their SQL."""

from . import capabilities, context, evaluation, governed, ingestion, planning, reading, relational, releases, retrieval, rules  # noqa: F401  registers
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
