"""All queries of the engine's own operators, with their DuckDB oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil

from plait import plans
from plait.plans.registry import QUERIES, SQL

for _m in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"plait.plans.{_m.name}")

__all__ = ["QUERIES", "SQL"]
