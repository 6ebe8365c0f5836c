"""All registered queries of the analytics operators, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("panel", "models", "periods", "signals", "labels", "valuation", "deals", "facts", "text", "evaluation")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict = {}
    for name in MODULES:
        for query, pair in import_module(f"tidemark.plans.{name}").QUERIES.items():
            if query in out:
                raise ValueError(f"query {query} is registered twice")
            out[query] = pair
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: pair[0] for name, pair in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: pair[1] for name, pair in _all().items() if pair[1]}
