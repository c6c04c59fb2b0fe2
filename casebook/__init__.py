"""Registered queries over the test tables, each with its SQL statement."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every module of the package, which registers its queries."""
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
