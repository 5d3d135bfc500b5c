"""Queries of the engine's operators over the test tables."""

from . import documents, ledgers, ranking, readers, structure  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
