"""Queries over the given tables, one per operator, each with the SQL that gives the same rows."""

from importlib import import_module

MODULES = ("prepare", "inspect", "forecasting", "tables")


def load():
    from catalog.registry import ORACLES, QUERIES

    for m in MODULES:
        import_module(f"catalog.{m}")
    return QUERIES, ORACLES
