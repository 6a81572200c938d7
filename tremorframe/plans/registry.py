"""All named queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sequences", "features", "scoring", "search", "learning", "live", "landing")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"tremorframe.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
