"""Imports every query module and hands out the registry."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from roomtable.plans import registry

_MODULES = ("governance", "evaluation", "regions", "image", "geometry", "catalogue", "streams")


def _load() -> None:
    for name in _MODULES:
        import_module(f"roomtable.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(registry.QUERIES)


def checks() -> dict[str, str]:
    _load()
    return dict(registry.CHECKS)


def inventory() -> dict[str, str]:
    _load()
    return dict(registry.INVENTORY)
