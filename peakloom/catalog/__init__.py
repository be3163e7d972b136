"""Runnable queries, one per operator, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

MODULES = ("preparation", "storage", "aggregates", "models", "assignment", "labelling", "streams")


def load():
    """Import every catalogue module and return (queries, oracle_sql)."""
    from peakloom.catalog.registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"peakloom.catalog.{name}")
    return dict(QUERIES), dict(ORACLES)
