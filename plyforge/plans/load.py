"""Imports every module that registers queries."""

from __future__ import annotations

from plyforge.operators import attacks, datasets, engine, features, lines, moves, readers, records, rewards, text, textbook, tokens  # noqa: F401
from plyforge.plans import registry
from plyforge.streaming import logs  # noqa: F401


def all_queries():
    return registry.queries()


def all_oracles():
    return registry.oracle_sql()
