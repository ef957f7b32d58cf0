"""All registered queries."""

from . import columns_queries, lifecycle_queries, registry_queries, stream_queries  # noqa: F401
from .register import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
