"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles, surface
from . import queries as core


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core.queries() | surface.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | surface.oracle_sql()
