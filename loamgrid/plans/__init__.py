"""Registered queries, grouped by subject; importing a module registers its queries."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("probability", "runs", "raster", "spatial", "store", "files", "streams", "evidence", "proposals")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"loamgrid.plans.{name}")
