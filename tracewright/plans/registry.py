"""All queries of the library by name, and their oracle SQL."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views

MODULES = ("derivatives", "terms", "campaign", "aggregates", "levels", "regression", "stagecaps", "probes", "search", "files", "live")


def _all() -> dict[str, tuple]:
    out = {}
    for m in MODULES:
        if importlib.util.find_spec(f"tracewright.plans.{m}"):
            out |= importlib.import_module(f"tracewright.plans.{m}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
