"""Named queries with their SQL twins, one module per area."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
