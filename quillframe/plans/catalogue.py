"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from quillframe.plans import file_queries, relational_queries, scalar_queries, stream_queries, table_queries, text_queries, tree_queries, type_queries  # noqa: F401
from quillframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
