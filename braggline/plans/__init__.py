"""Registered queries: each binds library operators to the adapter views."""

from importlib import import_module

MODULES = ("fractions", "metadata", "signal", "crystal", "correlations", "shapes", "series", "identification", "spot_tracks", "live", "ingest", "exports")


def _load():
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return import_module(f"{__name__}.registry")


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
