"""Registered checks: each operator on the shared tables next to the SQL that must agree with it."""

from __future__ import annotations

from importlib import import_module

from tabulon.checks.registry import ORACLES, QUERIES

_MODULES = (
    "basics",
    "shapes",
    "lookups",
    "criteria",
    "totals",
    "pivots",
    "rules",
    "scalars",
    "finance",
    "fits",
    "files",
    "streams",
)


def load() -> tuple[dict, dict]:
    for name in _MODULES:
        import_module(f"tabulon.checks.{name}")
    return QUERIES, ORACLES
