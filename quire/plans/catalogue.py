"""All queries by name, and their SQL. Importing the modules registers them."""

from __future__ import annotations

import importlib

from quire.plans.registry import QUERIES, SQL

MODULES = ("text_queries", "layout_queries", "table_queries", "record_queries", "page_queries", "matching_queries", "chart_queries", "pdf_queries")

for _m in MODULES:
    importlib.import_module(f"quire.plans.{_m}")

__all__ = ["QUERIES", "SQL"]
