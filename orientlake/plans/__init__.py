"""Named queries over the test tables."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every plan module and return the registry they filled."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
