"""All registered queries of the library."""

from __future__ import annotations

import importlib

from grainmill.registry import ORACLES, QUERIES, Query

MODULES = ("grainmill.plans.corpus", "grainmill.plans.filters", "grainmill.plans.relational", "grainmill.plans.measures", "grainmill.plans.tokens", "grainmill.plans.records")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracles() -> dict[str, str]:
    _load()
    return ORACLES
