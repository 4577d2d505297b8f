"""Registered queries over the given tables, each beside the SQL it must agree with."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every ``*_queries`` module so that its queries register."""
    for module in sorted(iter_modules(__path__), key=lambda m: m.name):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")
