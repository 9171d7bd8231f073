"""All queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .proxies import Proxies, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FAMILIES = ("scalars", "relations", "lines", "grids", "places", "fields", "shaping", "publishing", "checks", "assembly")


def query(needs: str = "", sql: str | None = None):
    """Register a function of the proxies as a query; ``needs`` names the proxies its SQL uses."""

    def add(f: Callable[[Proxies], DataFrame]):
        name = f.__name__.removeprefix("q_")
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Proxies(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(needs.split(), sql)
        return f

    return add


for _family in FAMILIES:
    importlib.import_module(f".{_family}", __package__)
