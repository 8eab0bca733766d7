"""Every query of the engine bound to the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from matchloom.catalog import registry

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
    importlib.import_module(f"{__name__}.{_m}")


def queries():
    return {name: registry.bound(name) for name in registry.BUILDERS}


def oracle_sql():
    return dict(registry.CHECKS)
