"""Registered queries, a module for each area."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
