"""Composite plans and the registered queries."""

from importlib import import_module

_MODULES = ("lookups", "scalars", "reference_data", "raster_data", "worlds", "feeds", "imports", "vector_files")


def registered_queries():
    """Names to callables, and names to SQL text."""
    from cartolith.plans import registry
    for module in _MODULES:
        import_module(f"cartolith.plans.{module}")
    return registry.QUERIES, registry.ORACLES
