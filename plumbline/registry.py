"""All registered queries of the profiling and quality library, and their SQL equivalents."""

from __future__ import annotations

from plumbline.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
