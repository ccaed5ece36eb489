"""Queries over the driver tables, each next to its SQL."""

from importlib import import_module

MODULES = (
    "sources pages chunking text lexical vectors ranking citations catalog conversations metrics streams"
).split()


def collect():
    queries, oracles = {}, {}
    for name in MODULES:
        mod = import_module(f"corpuslake.plans.bindings.{name}")
        queries.update(mod.QUERIES)
        oracles.update(mod.ORACLES)
    return queries, oracles
