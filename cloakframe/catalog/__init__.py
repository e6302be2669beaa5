"""Registered queries over the test tables, with an SQL twin for each one that SQL can express."""

from __future__ import annotations

from . import attack, audit, measure, noise, protect, quality, registry, search, sources, streams, synthetic

_FAMILIES = (protect, noise, synthetic, measure, attack, quality, search, audit, registry, sources, streams)


def all_queries() -> dict:
    return {name: fn for family in _FAMILIES for name, fn in family.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
