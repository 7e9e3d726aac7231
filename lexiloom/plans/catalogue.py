"""Every core query by name, each with its SQL twin where SQL can express it.

A module of queries has a dict ``QUERIES`` of callables (spark, sf_dir) -> DataFrame and a dict ``SQL``.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import lexiloom.plans as plans


def _modules():
    for found in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if found.name.startswith("q_"):
            yield importlib.import_module(f"{plans.__name__}.{found.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
