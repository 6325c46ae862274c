"""Registered queries over the driver's tables, one module a family of operators."""

from __future__ import annotations

from loomspark.queries.base import Query, collect

QUERIES: dict[str, Query] = collect()
