"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from driftwood.catalog.registry import REGISTRY

for _part in ("sources", "projections", "joins", "aggregates", "windows", "sampling", "scalars", "jobs"):
    import_module(f"driftwood.catalog.{_part}")

__all__ = ["REGISTRY"]
