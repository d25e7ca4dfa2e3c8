"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil
from types import SimpleNamespace


def load() -> SimpleNamespace:
    """Import every query module of this package and return what they registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    from . import registry

    return SimpleNamespace(queries=registry.QUERIES, oracles=registry.ORACLES)
