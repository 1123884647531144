"""Queries by theme, each with its SQL."""

from importlib import import_module
from pkgutil import iter_modules


def modules():
    return [import_module(f"{__name__}.{m.name}") for m in iter_modules(__path__) if m.name.endswith("_queries")]
