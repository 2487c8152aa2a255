"""All registered queries with the SQL that checks them."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ["masks", "tuning", "angles", "matching", "recordings", "population", "motion", "decoder", "signals", "tables", "streams"]

for _name in MODULES:
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
