"""Operators for preparing training data; nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib
import pkgutil


def _modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name) if m.name.startswith("p")]


def queries() -> dict:
    """All queries of the subpackage by name."""
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Their SQL, where there is any."""
    return {name: q for m in _modules() for name, q in m.SQL.items()}
