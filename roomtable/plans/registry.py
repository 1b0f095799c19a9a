"""Registry of named queries and of the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roomtable.sources.fixtures import SQL_VIEWS, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
INVENTORY: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register `build(fixtures) -> DataFrame` under a name.

    `covers` names the inventory rows the query stands for. `sql` may use the
    fixture views; those it mentions are put in front of it.
    """

    def keep(build: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
        INVENTORY[name] = covers
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return build

    return keep


def with_views(sql: str) -> str:
    """Put the fixture views the SQL needs, in order, into its WITH clause."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for view in SQL_VIEWS:
            if view not in needed and re.search(rf"\b{view}\b", text):
                needed.add(view)
                visit(SQL_VIEWS[view])

    visit(sql)
    heads = [f"{view} AS ({SQL_VIEWS[view]})" for view in SQL_VIEWS if view in needed]
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = "RECURSIVE ", body[len("WITH RECURSIVE "):]
        return f"WITH {recursive}{', '.join([*heads, body])}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join([*heads, body[5:]])}"
    return f"WITH {', '.join(heads)} {body}" if heads else body


def r(expression: str, digits: int) -> str:
    """SQL twin of functions.numbers.fixed."""
    if digits < 7:
        expression = _half_up(expression, 9)
    return _half_up(expression, digits)


def _half_up(expression: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"floor(({expression}) * {scale} + 0.5e0) / {scale}"
