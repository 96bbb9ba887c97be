"""All named queries."""

from __future__ import annotations

from importlib import import_module

from tracklane.registry.base import ORACLES, QUERIES

PARTS = ("fleet", "identity", "orders", "raw", "files", "live", "rows")


def load():
    for part in PARTS:
        import_module(f"tracklane.registry.{part}")
    return QUERIES, ORACLES
