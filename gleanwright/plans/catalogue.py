"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanwright.plans import core, pipelines, reports, responses, texts, validation

PARTS = (texts, reports, responses, validation, pipelines, core)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for part in PARTS for f in part.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.SQL.items()}
