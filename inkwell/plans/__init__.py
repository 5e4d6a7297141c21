"""Registered queries of the document engine."""

import importlib

from inkwell.plans.registry import ORACLES, QUERIES

for _module in ("observability", "retrieval", "catalog", "text", "security", "documents", "workflow", "understanding", "reporting", "structure"):
    importlib.import_module(f"inkwell.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
