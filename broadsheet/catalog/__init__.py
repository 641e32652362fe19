"""Registered queries and, where SQL can express them, the same question in ANSI SQL."""

from __future__ import annotations

import importlib

from broadsheet.catalog.base import QUERIES, SQL

for _section in ("scalars", "rows", "tags", "vectors", "dashboards", "enrichment"):
    importlib.import_module(f"broadsheet.catalog.{_section}")

__all__ = ["QUERIES", "SQL"]
