"""Collects registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.base import sql
from pluvio.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], body: str | None = None, **ctes: str) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} registered twice")
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if body is not None:
        ORACLE[name] = sql(body, **ctes)
