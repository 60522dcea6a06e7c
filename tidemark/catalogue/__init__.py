"""Registered queries: each operator on the given tables, with equivalent SQL."""

from importlib import import_module

from tidemark.catalogue.registry import QUERIES, SQL

for _name in ("sources", "cleaning", "alignment", "aggregates", "windows", "contributions",
              "text", "pairs", "factors", "evaluation", "news"):
    import_module(f"tidemark.catalogue.{_name}")

__all__ = ["QUERIES", "SQL"]
