"""Query registry: name -> (Spark query over the driver tables, DuckDB oracle SQL).

Demo modules register with ``@register(name, sql, views=...)``. ``sql=None``
means no SQL twin exists (iterative or model-based operators); those are
checked by invariant tests instead.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    heavy: bool = False


REGISTRY: dict[str, Entry] = {}

DEMO_MODULES = [
    "agrispark.plans.demo_sources",
    "agrispark.plans.demo_schema",
    "agrispark.plans.demo_joins",
    "agrispark.plans.demo_stats",
    "agrispark.plans.demo_series",
    "agrispark.plans.demo_select",
    "agrispark.plans.demo_scalar",
    "agrispark.plans.demo_features",
    "agrispark.plans.demo_decide",
    "agrispark.plans.demo_models",
    "agrispark.plans.demo_fits",
    "agrispark.plans.demo_jobs",
]


def register(name: str, sql: str | None = None, views: tuple = (), heavy: bool = False):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = Entry(name, fn, with_views(sql, *views) if sql else None, heavy)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    for m in DEMO_MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name != m:
                raise
    return REGISTRY
