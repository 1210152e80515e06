"""All registered queries."""

from __future__ import annotations

import importlib

from framespan.plans.registry import ORACLES, QUERIES

for _name in ("frames", "depth", "loops", "registration", "segments", "clouds", "cameras", "scenes", "models", "missing", "sources"):
    importlib.import_module(f"framespan.plans.checks_{_name}")

__all__ = ["ORACLES", "QUERIES"]
