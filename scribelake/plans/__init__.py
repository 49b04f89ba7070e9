"""Registered queries over the shared tables."""

from __future__ import annotations

import importlib
import pkgutil

from scribelake.plans import catalog


def registered():
    """The catalog with every query module loaded."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return catalog
