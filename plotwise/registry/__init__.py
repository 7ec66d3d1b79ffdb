"""All registered queries."""

import importlib
import pkgutil


def load_all():
    from plotwise.registry import core

    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        importlib.import_module(f"{__name__}.{m.name}")
    return core.QUERIES, core.ORACLES
