"""Catalog of registered queries."""


def load() -> None:
    """Import every query module so that it registers its queries."""
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
