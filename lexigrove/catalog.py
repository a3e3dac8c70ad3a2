"""All queries of the library, with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

import lexigrove.queries
from lexigrove import registry

for found in pkgutil.iter_modules(lexigrove.queries.__path__):
    importlib.import_module(f"lexigrove.queries.{found.name}")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
