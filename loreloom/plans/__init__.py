"""Queries over the given tables, one module per family."""

import importlib

from loreloom.plans.registry import ORACLES, QUERIES

MODULES = ("text", "retrieval", "tables", "neardup", "graph", "lifecycle", "usage", "quality", "streams", "sources", "states")

for _name in MODULES:
    importlib.import_module(f"loreloom.plans.{_name}")

__all__ = ["QUERIES", "ORACLES"]
