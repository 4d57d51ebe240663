"""All registered queries and their SQL."""

from . import host_queries  # noqa: F401  registers its queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
