"""The checked queries, by area."""

from __future__ import annotations

import importlib

AREAS = ("scalars", "chunks", "splits", "forms", "web", "ops")


def load():
    """Import every area and return (queries, oracle SQL)."""
    from . import registry

    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    return registry.QUERIES, registry.ORACLES
